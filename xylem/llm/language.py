"""Language identification, words first.

A text's words are its runs of letters in lower case. A known word adds its log frequency in each language; an unseen
one is covered from the left by the longest known n-grams (up to four characters, its two ends marked), each shorter
one only where no longer one is known. The language of the highest sum wins; the score is its share of the
likelihoods. Word and n-gram frequencies come from a bounded sample of labelled texts of each language.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.common import lean, parts

#: Texts to learn from per language (about; chosen by a hash of id and text), and characters of the longest n-gram.
TRAIN_TEXTS, LONGEST = 1000, 4
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Unseen words kept in a worker's memory.
CACHE = 100_000
#: What a backoff costs: an n-gram tells less than a word.
BACKOFF = 0.4
#: Letters that a text is granted as known: too few say nothing about its language.
GRANTED = 8


def words(text: str | None) -> list[str]:
    found = WORD.findall((text or "").lower())
    return found if any(c.isalpha() for w in found for c in w) else []


def grams(word: str):
    marked = f"<{word}>"
    for n in range(1, LONGEST + 1):
        for i in range(len(marked) - n + 1):
            yield n, marked[i : i + n]


def _counted(batches):
    """(lang, text) -> (lang, n, item, times): words have n = 0."""
    for batch in batches:
        of: dict[str, Counter] = {}
        for part in parts([batch]):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                of.setdefault(lang, Counter()).update(words(text))
        rows: Counter = Counter()
        for lang, count in of.items():
            for w, k in count.items():
                rows[lang, 0, w] += k
                for n, g in grams(w):
                    rows[lang, n, g] += k
        lang, n, item = ([x[i] for x in rows] for i in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(n, pa.int32()), pa.array(item, pa.string()), pa.array(list(rows.values()), pa.int64())], ["lang", "n", "item", "times"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_TEXTS) -> dict:
    """{langs, items: {n: (items, float32 log frequencies, one row per item)}, floor, cover}.

    All words and n-grams of the sample are kept; the model is bounded by per_language alone. floor is the log frequency
    of a word that a language lacks; cover, the share of a language's letters to be expected in known words of a text
    that taught nothing: what is not in words seen once. Rows without a language or text teach nothing, repeated rows
    once, null ids like others; an empty table gives no languages. Texts are learnt whole. One number a language goes to
    the driver before the model does. Ids must be numbers or texts of numbers.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return {"langs": [], "items": {}, "floor": [], "cover": []}
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, per_language / n))) for k, n in counts.items()])
    sample = rows.where(F.pmod(F.xxhash64("id", "text", F.lit("language")), F.lit(1 << 40)) < share * float(1 << 40))
    total = sample.select("id", "lang", "text").distinct().select("lang", "text").mapInArrow(lean(_counted), "lang string, n int, item string, times long").groupBy("lang", "n", "item").agg(F.sum("times").alias("times"))
    items: dict[int, dict[str, np.ndarray]] = {n: {} for n in range(LONGEST + 1)}
    for r in total.select("lang", "n", "item", "times").toLocalIterator(prefetchPartitions=True):
        items[r.n].setdefault(r.item, np.zeros(len(langs), np.float32))[langs.index(r.lang)] = r.times
    model, floor, known, letters = {}, [], 0, 0
    for n, found in items.items():
        names = sorted(found)
        k = np.array([found[x] for x in names], np.float64).reshape(len(names), len(langs))
        model[n] = names, np.log((k + 0.5) / (k.sum(axis=0) + 0.5 * (len(names) + 1))).astype(np.float32)
        if n == 0:
            floor, known = np.log(0.5 / (k.sum(axis=0) + 0.5 * (len(names) + 1))), np.array([len(x) for x in names], np.float64) @ np.where(k > 1, k, 0)
        elif n == 1:
            letters = k[[x not in "<>" for x in names]].sum(axis=0)
    return {"langs": langs, "items": model, "floor": floor, "cover": known / np.maximum(letters, 1)}


class Rows(dict):
    """Row of each word in a growing table of log frequencies; an unseen word's row is made when it first comes."""

    def __init__(self, model: dict) -> None:
        names, known = model["items"][0]
        self.known = dict(zip(names, range(len(names)), strict=True))
        super().__init__(self.known)
        self.grams = [dict(zip(names, (tuple(map(float, x)) for x in logs), strict=True)) for names, logs in (model["items"][n] for n in range(1, LONGEST + 1))]
        self.table = np.concatenate([known, np.zeros((CACHE, known.shape[1]), np.float32)])
        self.used = self.first = len(names)
        #: Letters of each known word, in the languages that have it.
        self.letters = (known > model["floor"] + 0.5) * np.array([len(x) for x in names], np.float32).reshape(-1, 1)

    def __missing__(self, word: str) -> int:
        if self.used == len(self.table):
            return -1
        self.table[self.used] = self.cover(word)
        self[word] = self.used
        self.used += 1
        return self.used - 1

    def cover(self, word: str) -> list[float]:
        marked, i, total = f"<{word}>", 0, [0.0] * self.table.shape[1]
        while i < len(marked):
            for n in range(LONGEST, 0, -1):
                if (x := self.grams[n - 1].get(marked[i : i + n])) is not None and i + n <= len(marked):
                    total = [a + BACKOFF * b for a, b in zip(total, x, strict=True)]
                    i += n
                    break
            else:
                i += 1
        return total

    def places(self, text_words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, text_words), np.int64, len(text_words))

    def known_share(self, text_words: list[str], at: np.ndarray, lang: int) -> float:
        """Share of the letters that is in words the language is known to have."""
        return float(self.letters[at[(at >= 0) & (at < self.first)], lang].sum(dtype=np.float64) + GRANTED) / (sum(map(len, text_words)) + GRANTED)

    def sums(self, text_words: list[str], at: np.ndarray | None = None) -> np.ndarray:
        at = self.places(text_words) if at is None else at
        if (at < 0).any():  # full: what the text has beyond the table is added one by one
            total = self.table[at[at >= 0]].sum(axis=0, dtype=np.float64)
            total += np.sum([self.cover(w) for w, k in zip(text_words, at, strict=True) if k < 0], axis=0)
            self.clear()
            self.update(self.known)
            self.used = self.first
            return total
        return self.table[at].sum(axis=0, dtype=np.float64)


def predict(texts: list[str | None], langs: list[str], rows: Rows | None) -> tuple[list[str], list[float]]:
    names, scores = [], []
    for text in texts:
        found = words(text) if langs else []
        if not found:
            names.append(UNKNOWN)
            scores.append(0.0)
            continue
        total = rows.sums(found)
        best = int(total.argmax())
        names.append(langs[best])
        scores.append(float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum()))
    return names, scores


def _predicted(shared):
    def predicted(batches):
        langs, rows = shared.value["langs"], Rows(shared.value) if shared.value["langs"] else None
        for batch in parts(batches):
            names, scores = predict(batch.column("text").to_pylist(), langs, rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return predicted


def in_known_language(docs: DataFrame, model: dict, least_score: float, least_known: float, text_col: str = "text") -> DataFrame:
    """docs whose text is in one of the model's languages; rows are let through where they are read, without a shuffle.

    The likeliest language must have such a score, which only parts the taught languages from each other, and the share of
    the text's letters that is in words of that language must be least_known of what is expected of it. Null, empty and
    letterless texts go. All columns are kept, whatever their names; repeated rows and null ids are judged each; an empty
    table stays empty.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def passed(batches):
        model = shared.value
        rows = Rows(model) if model["langs"] else None

        def passes(text: str | None) -> bool:
            found = words(text) if rows else []
            if not found:
                return False
            places = rows.places(found)
            total = rows.sums(found, places)
            best = int(total.argmax())
            if 1 / np.exp(np.clip(total - total[best], -700, 0)).sum() < least_score:
                return False
            return rows.known_share(found, places, best) >= least_known * model["cover"][best]

        for batch in parts(batches):
            yield batch.filter(pa.array([passes(text) for text in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(lean(passed), docs.schema)


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score for each row of docs, by its whole text alone.

    A text that is null, empty or has no letter, and any text under a model of no languages, is `und` with score 0. Ties
    go to the first language in order. Texts of any length are read whole, repeated rows judged each, an empty table
    gives an empty result, a null id stays null (others must be numbers or texts of numbers). Other columns are not read, so their names
    don't matter. The model is broadcast: the words of per_language texts of each language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(_predicted(shared)), "id long, lang_pred string, score double")
    return rows.withColumnRenamed("id", id_col) if id_col != "id" else rows
