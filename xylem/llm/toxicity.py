"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

A text, in lower case with single blanks, is cut into windows of WINDOW bytes, STEP bytes apart, that leave out no
byte. A window's gain is the bytes that it takes with an ordinary dictionary less those with a toxic one. Dictionaries
are trained on whole labelled texts, toxic ones and ordinary ones, in pairs of several sizes; both of a pair stand
behind the same base, trained on ordinary texts, so that what all texts share costs the same with either and the gain
is left to what toxic texts repeat. The gains of a window by all pairs are added and their least is taken: what one
pair holds by chance, another doesn't. How many windows reach each gain makes a text's probability (logistic regression,
both labels weighing the same), calibrated on texts that the dictionaries of their fold were not trained on.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.common import Scratch, lean, parts

#: Labelled texts to learn from, at most so many of either label (about; by a hash of the id) and so many bytes of each.
TRAIN_TEXTS, TRAIN_BYTES = 3000, 16 << 20
#: Bytes of a window, and from one to the next.
WINDOW, STEP = 96, 48
#: Bytes of a dictionary and of the segments that training picks for it: of the base, and of each pair.
BASE, PAIRS = (65_536, 24), ((8_192, 12), (24_576, 16), (49_152, 24))
#: Bytes of the units whose repeats training counts, and of a training sample.
UNIT, SAMPLE = 8, 512
LEVEL = 3
#: Parts of the sample, each calibrated by dictionaries trained on the others.
FOLDS = 3
#: Gains are counted from -LEAST_GAIN to MOST_GAIN, those beyond with the last.
LEAST_GAIN, MOST_GAIN = 6, 10
#: A text is called toxic from this score on.
THRESHOLD = 0.7


def normal(text: str | None) -> bytes:
    return b" " + " ".join((text or "").lower().split()).encode("utf-8", "replace") + b" "


def windows(text: str | None) -> list[bytes]:
    body = normal(text)
    return [body[i : i + WINDOW] for i in range(0, max(1, len(body) - WINDOW + STEP), STEP)]


def train(texts: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary of at most `size` bytes, trained on whole texts in samples of SAMPLE bytes. Few samples are repeated until training takes them; no text gives none."""
    samples = [t[i : i + SAMPLE] for t in texts for i in range(0, len(t), SAMPLE)]
    if not samples:
        return b""
    while len(samples) < 16 or sum(map(len, samples)) < 2 * size:
        samples = samples + samples
    return zstandard.train_dictionary(size, samples, k=segment, d=UNIT, f=20, split_point=1.0, accel=1, level=LEVEL).as_bytes()


def compressor(dictionary: bytes):
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False).compress


class Gains:
    """Gains of windows by each pair of dictionaries."""

    def __init__(self, base: bytes, pairs: list[tuple[bytes, bytes]]) -> None:
        self.pairs = [(compressor(base + ordinary), compressor(base + toxic)) for toxic, ordinary in pairs]

    def of(self, cut: list[bytes]) -> np.ndarray:
        """One row per pair, one column per window."""
        return np.array([[len(ordinary(w)) - len(toxic(w)) for w in cut] for ordinary, toxic in self.pairs])


def counted(gains: np.ndarray) -> list[float]:
    """Of one row of gains: how many windows have each gain and above (or, of losses, below), as logarithm and as share."""
    at = np.bincount(np.clip(gains, -LEAST_GAIN, MOST_GAIN) + LEAST_GAIN, minlength=LEAST_GAIN + MOST_GAIN + 1).astype(float)
    up, down = at[::-1].cumsum()[::-1][LEAST_GAIN + 1 :], at.cumsum()[:LEAST_GAIN]
    return [*np.log1p(up), *(5 * np.sqrt(up / len(gains))), *np.log1p(down), *(5 * np.sqrt(down / len(gains))), gains.mean(), gains.std()]


def features(text: str | None, gains: Gains) -> list[float]:
    cut = windows(text)
    each = gains.of(cut)
    return [1.0, *counted(each.sum(axis=0) // len(each)), *counted(each.min(axis=0)), np.log1p(len(cut)) / 5]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 3.0) -> np.ndarray:
    """Weights by Newton's method, both labels weighing the same."""
    share = y.mean()
    of = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (of * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(h, x.T @ (of * (y - p)) - ridge * w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w


def trained(texts: list[tuple[str, int]]) -> dict:
    """(text, label) -> the base and the (toxic, ordinary) pairs."""
    toxic, ordinary = ([normal(t) for t, y in texts if y == label] for label in (1, 0))
    return {"base": train(ordinary, *BASE), "pairs": [(train(toxic, *kind), train(ordinary, *kind)) for kind in PAIRS]}


def learn(texts: list[tuple[int, str, int]]) -> dict:
    """(id, text, label) -> {base, pairs: dictionaries; weights}. The order of the rows does not matter.

    Without a text of either label nothing parts them: there are no weights, and every text's score is 0.5.
    """
    texts = [(t, y) for _, t, y in sorted(texts, key=lambda r: (zlib.crc32(b"order%d" % r[0]), r[0], r[1]))]
    if len({y for _, y in texts}) < 2:
        return {"base": b"", "pairs": [], "weights": []}
    x, labels = [], []
    for k in range(FOLDS):
        held = texts[k::FOLDS]
        model = trained([r for i, r in enumerate(texts) if i % FOLDS != k])
        gains = Gains(**model)
        x += [features(t, gains) for t, _ in held]
        labels += [y for _, y in held]
    return trained(texts) | {"weights": logistic(np.array(x), np.array(labels, float)).tolist()}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = TRAIN_TEXTS, per_class_bytes: int = TRAIN_BYTES) -> dict:
    """Learns from labelled rows of docs: about per_class texts of each label and per_class_bytes at most, chosen by a hash of the id.

    Labels other than 0 and 1, and null ids, are left out; an id labelled twice has its larger label; rows that share
    an id are learnt from each. A null text is empty. Empty tables teach nothing (see learn). Ids must be numbers or texts of numbers.
    """
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and id is not null").groupBy("id").agg(F.max("y").alias("y"))
    counts = {r.y: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("y") == 1, per_class / max(1, counts.get(1, 0))).otherwise(per_class / max(1, counts.get(0, 0)))
    chosen = marks.where(F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 40)) < share * float(1 << 40)).collect()
    # About 2 * per_class ids, so they are sent to the texts and no text is shuffled.
    chosen = F.broadcast(docs.sparkSession.createDataFrame([(r.id, r.y) for r in chosen], "id long, y int"))
    scratch = Scratch()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(chosen, "id")
    rows = scratch.save(rows, "labelled")
    left, taken = {0: per_class_bytes, 1: per_class_bytes}, []
    for r in rows.select("id", "y", F.octet_length("text").alias("n"), F.xxhash64("text").alias("h")).orderBy(F.xxhash64("id"), "id", "h").collect():
        if r.n <= left[r.y]:
            left[r.y] -= r.n
            taken.append((r.id, r.h))
    of = F.broadcast(docs.sparkSession.createDataFrame(sorted(set(taken)), "id long, h long"))
    texts = rows.withColumn("h", F.xxhash64("text")).join(of, ["id", "h"]).select("id", "text", "y").collect()
    scratch.clear()
    return learn([(r.id, r.text, r.y) for r in texts])


def _scored(shared):
    def scored(batches):
        model = shared.value
        gains, weights = Gains(model["base"], model["pairs"]), np.array(model["weights"])
        for batch in parts(batches):
            texts = batch.column("text").to_pylist()
            if len(weights):
                x = np.array([features(t, gains) for t in texts]).reshape(-1, len(weights))
                score = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            else:
                score = np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score)], ["id", "score"])

    return scored


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id_col, score, predicted for each row of docs, by its whole text alone, whatever its length.

    A null or empty text is scored as one window without a word. Repeated rows are scored each, an empty table gives an
    empty result, a null id stays null; others must be numbers or texts of numbers. Other columns are not read, so
    their names don't matter. The model is about 200 kB and broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(_scored(shared)), "id long, score double")
    return rows.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
