"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH, exact edit distance.

Everything is in words (blanks part them, A-Z in lower case). A walk over a window repeats its current word or steps
to the next as a random function of step and word says, so that two windows a few edits apart are mapped to sequences
that differ in few places. Some places, sampled at random, make a key; many walks with a sample each make the keys of
a window. A window has its item's size; an item of more than LONGEST words is cut into even parts, each searched as an
item, since one part at least has no larger share of edits than the whole. The number of walks of a size is what finds
TARGET of windows edited by MOST_EDITS. Windows begin at every word of a document, save where no item can be: an item
with its edits holds a run of words of some length untouched, so only words near a run of an item's words are begun
with, which loses nothing. What meets is checked by the edit distance between the whole item and the place around.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.common import PLACE, Powers, chunks, lean, mix64, parts, text_bytes, word_hashes

#: An item is in a document if so small a share of its words is edited.
MOST_EDITS = 0.2
#: Words of a window at most; places of a sample; walks at most; share of windows edited by MOST_EDITS that the walks find.
LONGEST, PLACES, WALKS, TARGET = 48, 3, 64, 0.97
#: Words of items in one pass over the documents: bounds what is broadcast (some 300 bytes a word).
PASS_WORDS = 200_000
FILTER_BITS = 21
#: Windows whose walks are made at once.
SLAB = 1 << 14

WALK_SEED = mix64(np.arange(1, WALKS + 1, dtype=np.uint64) * np.uint64(0x1234567))


def most_edits(n: int) -> int:
    return int(MOST_EDITS * n)


def untouched(n: int) -> int:
    """Words in a row that an item of n words with most_edits(n) edits keeps at least: what is left, in one more runs than edits."""
    k = most_edits(n)
    return -(-(n - k) // (k + 1))


def segments(n: int) -> list[tuple[int, int]]:
    """(first word, words) of the parts in which an item of n words is searched."""
    count = -(-n // LONGEST)
    at = [k * n // count for k in range(count + 1)] if count else [0]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


@lru_cache(maxsize=None)
def _samples(width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each walk: its places among 2 * width steps, and their multipliers."""
    rng = np.random.default_rng([99, width])
    at = np.stack([np.sort(rng.choice(2 * width, min(PLACES, 2 * width), replace=False)) for _ in range(WALKS)])
    return at, rng.integers(0, 2**64, at.shape, dtype=np.uint64) | np.uint64(1)


def window_keys(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, walk: int, widths: list[int]) -> dict[int, np.ndarray]:
    """For each width the keys of one walk over the windows of so many words (or up to ends) that begin at starts."""
    uses: dict[int, list[tuple[int, np.uint64]]] = {}
    for width in widths:
        for step, factor in zip(*(x[walk] for x in _samples(width)), strict=True):
            uses.setdefault(int(step), []).append((width, factor))
    keys = {width: np.zeros(len(starts), np.uint64) for width in widths}
    padded, stop = np.append(words, np.uint64(0)), np.minimum(starts + max(widths), ends)
    at = starts.copy()
    for step in range(max(uses) + 1):
        word = padded[at]
        for width, factor in uses.get(step, ()):
            keys[width] += np.where((at < starts + width) & (at < ends), word, np.uint64(0)) * factor
        coins = mix64(word ^ (WALK_SEED[walk] + np.uint64(step // 64))) >> np.uint64(step % 64)
        at += (coins & np.uint64(1)).astype(at.dtype)
        np.minimum(at, stop, out=at)
    return {width: mix64(key ^ mix64(np.array([width << 8 | walk], np.uint64))) for width, key in keys.items()}


@lru_cache(maxsize=None)
def walks_of(width: int) -> int:
    """The least number of walks that find TARGET of random windows with most_edits(width) random edits, as simulated."""
    rng, trials = np.random.default_rng([7, width]), 256
    whole = [rng.integers(1, 1 << 62, width).astype(np.uint64) for _ in range(trials)]
    altered = []
    for words in whole:
        out = words.tolist()
        for _ in range(most_edits(width)):
            at, kind = int(rng.integers(len(out))), int(rng.integers(3))
            out[at : at + (kind != 1)] = [] if kind == 2 else [int(rng.integers(1, 1 << 62))]
        altered.append(np.array(out, np.uint64))

    def ranges(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ends = np.cumsum([len(x) for x in texts])
        return np.concatenate(texts), ends - [len(x) for x in texts], ends

    one, two, found = ranges(whole), ranges(altered), np.zeros(trials, bool)
    for walk in range(WALKS):
        found |= window_keys(*one, walk, [width])[width] == window_keys(*two, walk, [width])[width]
        if found.mean() >= TARGET:
            return walk + 1
    return WALKS


def edit_distance(item: np.ndarray, place: np.ndarray) -> tuple[int, int]:
    """Least edits between item and any stretch of place, and where the best stretch ends (the first such)."""
    j = np.arange(len(place) + 1)
    row = np.zeros(len(place) + 1, np.int64)
    for k, word in enumerate(item):
        best = row + 1
        best[1:] = np.minimum(best[1:], row[:-1] + (place != word))
        best[0] = k + 1
        row = np.minimum.accumulate(best - j) + j
    end = int(row.argmin())
    return int(row[end]), end


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every `size` words in a row, by its first word."""
    total = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for j in range(size):
        total += words[j : len(words) - size + 1 + j] * PLACE[j]
    return mix64(total)


def _table(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    return keys[order], *(v[order] for v in values)


def index(items: list[tuple[int, np.ndarray]]) -> dict:
    """What a pass looks up. Equal items are one, with several ids.

    runs: by run length, the sorted hashes of the items' runs, how far before and behind one a window may begin, and a
    filter; windows: by width, for each walk the sorted keys with item and first word of the windows; words, ids: of each item.
    """
    of: dict[bytes, int] = {}
    words, ids = [], []
    for item, w in items:
        if not len(w):
            continue
        k = of.setdefault(w.tobytes(), len(words))
        if k == len(words):
            words.append(w)
            ids.append([])
        ids[k].append(item)
    held: dict[int, list[tuple[np.ndarray, int, int]]] = {}
    cut: dict[int, list[tuple[int, int]]] = {}
    for k, w in enumerate(words):
        n, pieces = len(w), segments(len(w))
        reach = n + most_edits(n)
        held.setdefault(untouched(n), []).append((run_hashes(w, untouched(n)), reach, reach if len(pieces) > 1 else 0))
        for first, width in pieces:
            cut.setdefault(width, []).append((k, first))
    runs = {}
    for size, found in held.items():
        keys, before, behind = _table(np.concatenate([h for h, *_ in found]), *(np.concatenate([np.full(len(f[0]), f[i]) for f in found]) for i in (1, 2)))
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        maybe = np.zeros(1 << FILTER_BITS, bool)
        maybe[keys >> np.uint64(64 - FILTER_BITS)] = True
        runs[size] = keys[at], np.maximum.reduceat(before, at), np.maximum.reduceat(behind, at), np.packbits(maybe)
    windows = {}
    for width, found in cut.items():
        number, first = (np.array(x) for x in zip(*found, strict=True))
        body = np.concatenate([words[k][a : a + width] for k, a in found])
        starts = np.arange(len(found)) * width
        windows[width] = [_table(window_keys(body, starts, starts + width, walk, [width])[width], number, first) for walk in range(walks_of(width))]
    return {"runs": runs, "windows": windows, "words": words, "ids": ids}


def _starts(words: np.ndarray, before: np.ndarray, index: dict, filters: dict) -> np.ndarray:
    """The words of the texts at which a window of an item in its place may begin."""
    mark = np.zeros(len(words) + 1, np.int32)
    for size, (keys, ahead, behind, _) in index["runs"].items():
        mine = run_hashes(words, size)
        hit = np.flatnonzero(filters[size][mine >> np.uint64(64 - FILTER_BITS)])
        place = np.minimum(np.searchsorted(keys, mine[hit]), len(keys) - 1)
        same = keys[place] == mine[hit]
        hit, place = hit[same], place[same]
        text = np.searchsorted(before, hit, "right") - 1
        np.add.at(mark, np.maximum(hit - ahead[place], before[text]), 1)
        np.add.at(mark, np.minimum(hit + behind[place] + 1, before[text + 1]), -1)
    return np.flatnonzero(np.cumsum(mark[:-1]) > 0)


def _candidates(words: np.ndarray, before: np.ndarray, starts: np.ndarray, index: dict) -> np.ndarray:
    """Distinct (text, item, word at which the item would begin) whose windows share a key with the item's, in order."""
    out = [np.zeros((0, 3), np.int64)]
    most = max((len(x) for x in index["windows"].values()), default=0)
    for k in range(0, len(starts), SLAB):
        at = starts[k : k + SLAB]
        text = np.searchsorted(before, at, "right") - 1
        ends, met = before[text + 1], []
        for walk in range(most):
            widths = [w for w, tables in index["windows"].items() if walk < len(tables)]
            for width, mine in window_keys(words, at, ends, walk, widths).items():
                keys, number, first = index["windows"][width][walk]
                lo, hi = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
                hit = np.flatnonzero(hi > lo)
                n = (hi - lo)[hit]
                entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[hit], n)
                hit = np.repeat(hit, n)
                met.append(np.stack([text[hit], number[entry], at[hit] - first[entry]], axis=1))
        out.append(np.unique(np.concatenate(met), axis=0))
    return np.unique(np.concatenate(out), axis=0)


def _found(words: np.ndarray, before: np.ndarray, index: dict, filters: dict):
    """(row, item, distance, first word, end word) for the texts whose words begin at before[row]."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    last = None
    for r, i, at in _candidates(words, before, _starts(words, before, index, filters), index).tolist():
        item, first = index["words"][i], int(before[r])
        n, most = len(item), most_edits(len(item))
        known = best.get((r, i))
        if known and known[0] == 0:
            continue
        if at >= first and at + n <= before[r + 1] and (words[at : at + n] == item).all():
            best[r, i] = 0, at - first, at - first + n
            continue
        # A place is searched with 2 * most + 1 words around, so once for all beginnings of most + 1 in a row.
        if last == (here := (r, i, at // (most + 1))):
            continue
        last = here
        lo, hi = max(first, at - 2 * most - 1), min(int(before[r + 1]), at + n + 2 * most + 1)
        if np.isin(item, words[lo:hi]).sum() < n - most:
            continue
        edits, end = edit_distance(item, words[lo:hi])
        if edits <= most and (not known or edits < known[0]):
            _, back = edit_distance(item[::-1], words[lo : lo + end][::-1])
            best[r, i] = edits, lo + end - back - first, lo + end - first
    return [(r, i, *found) for (r, i), found in best.items()]


def _hits(shared):
    """A function of a string column: (row, item number, distance, first word, end word) of what its texts hold."""
    table, powers = shared.value, Powers()
    filters = {size: np.unpackbits(run[3]).astype(bool) for size, run in table["runs"].items()}

    def hits(column: pa.Array) -> list[tuple[int, int, int, int, int]]:
        out = []
        body, offsets = text_bytes(column)
        for i, j in chunks(offsets):
            words, _, before = word_hashes(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], powers)
            out += [(i + r, *rest) for r, *rest in _found(words, before, table, filters)]
        return out

    return hits


def _matched(shared):
    def matched(batches):
        hits, ids, items = _hits(shared), shared.value["ids"], shared.value["words"]
        for batch in parts(batches):
            docs = batch.column("id").to_pylist()
            out = [(docs[r], item, len(items[k]), d, a, b) for r, k, d, a, b in hits(batch.column("text")) for item in ids[k]]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "n_words", "distance", "start_word", "end_word"])

    return matched


def _clean(shared, at: int):
    def clean(batches):
        hits = _hits(shared)
        for batch in parts(batches):
            keep = np.ones(len(batch), bool)
            keep[[r for r, *_ in hits(batch.column(at))]] = False
            yield batch.filter(pa.array(keep))

    return clean


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    body, offsets = text_bytes(pa.array(texts, pa.string()))
    words, _, before = word_hashes(body, offsets, Powers())
    return [words[before[k] : before[k + 1]] for k in range(len(texts))]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_words, distance, start_word, end_word: one row for each row of docs and item that it holds.

    distance is the word edits of the best place found, MOST_EDITS of the item's words at most (ties: the first); places
    are in words of the document. Items and documents that are null, empty or blank match nothing, an empty table
    neither. Repeated rows and equal items are matched each; null ids stay null, others must be numbers or texts of
    numbers. Texts of any length are searched whole. Other columns are not read, so their names don't matter. The benchmark is read in
    passes of PASS_WORDS words, each over all documents; only one pass's items are on the driver.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = None
    for shared in _passes(benchmark, item_col, item_text):
        found = rows.mapInArrow(lean(_matched(shared)), "doc_id long, item_id long, n_words long, distance long, start_word long, end_word long")
        out = found if out is None else out.unionAll(found)
    return out


def _passes(benchmark: DataFrame, item_col: str, item_text: str):
    """The index of each pass, broadcast."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    passes = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // (5 * PASS_WORDS)))
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k).orderBy("item", "text").collect()
        words = item_words([r.text for r in part])
        yield benchmark.sparkSession.sparkContext.broadcast(index(list(zip([r.item for r in part], words, strict=True))))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without those that hold an item, by their text alone; rows are let through where they are read, without a shuffle.

    All columns are kept whatever their names, repeated rows and null ids are judged each; null, empty and blank texts
    stay, and so does every row when the benchmark is empty.
    """
    at = docs.columns.index(text_col)
    for shared in _passes(benchmark, item_col, item_text):
        docs = docs.mapInArrow(lean(_clean(shared, at)), docs.schema)
    return docs
