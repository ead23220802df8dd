"""Near-duplicates of texts by b-bit MinHash.

Words are what blanks (space, tab to carriage return) part, A-Z in lower case; a text's set holds its distinct
shingles of five words, or the whole sequence where there are fewer. Texts with equal sets form a class first.
Banded minima give candidates among classes; the low two bits of all minima, packed, give a similarity estimate
corrected for chance collisions, and what it cannot rule out (five standard errors) is confirmed on the full sets.

Work goes in three steps so that no group's pairs are ever written out: members of a bucket against its smallest
member; components of the links found; then, only for buckets that still hold several components, all pairs between
components, in blocks of bounded size whose tasks report a spanning forest of links and nothing else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.common import Forest, Powers, Scratch, blocked, chunks, connected_components, fresh, group_starts, lean, mix64, parts, shingle_hashes, small_pairs, text_bytes, whole_groups, with_class, word_hashes

SHINGLE = 5
SIMILAR_PERCENT = 75
BANDS, ROWS = 40, 5
PERMUTATIONS = BANDS * ROWS
#: Minima keep this many low bits each.
LOW_BITS = 2
SIG_WORDS = -(-PERMUTATIONS * LOW_BITS // 64)
#: Two texts of similarity 0.75 are estimated lower than this once in some millions.
LEAST_ESTIMATE = 0.56
#: Classes, and bytes of their sets, of one block of the exact step (about; one set may be larger); a task holds two blocks.
BLOCK, BLOCK_BYTES = 256, 16 << 20
#: Pairs of one hub that meet a copy of it, about.
PER_HUB = 256
#: Buckets of no more rows are compared pair by pair, many at once; so many pairs at a time.
SMALL, PAIRS = 48, 1 << 17

_RNG = np.random.default_rng(77)
MULTIPLY = _RNG.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
ADD = _RNG.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
IN_BAND = _RNG.integers(0, 2**64, ROWS, dtype=np.uint64) | np.uint64(1)
OF_BAND = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))


def text_sets(column: pa.Array, tables: Powers):
    """For each text, the sorted distinct hashes of its shingles."""
    body, offsets = text_bytes(column)
    for i, j in chunks(offsets):
        at = offsets[i : j + 1] - offsets[i]
        words, _, before = word_hashes(body[offsets[i] : offsets[j]], at, tables)
        for k in range(j - i):
            yield np.unique(shingle_hashes(words[before[k] : before[k + 1]], SHINGLE))


def minima(hashes: np.ndarray) -> np.ndarray:
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 128):
        part = low[i : i + 128, None] * MULTIPLY
        part += ADD
        np.minimum(best, part.min(axis=0), out=best)
    return best


def packed(best: np.ndarray) -> np.ndarray:
    """The low bits of each minimum, 32 minima in a uint64."""
    bits = np.zeros(SIG_WORDS * 32, np.uint64)
    bits[:PERMUTATIONS] = best & np.uint32(3)
    return (bits.reshape(SIG_WORDS, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64)


def estimates(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarity by equal low bits, less what unequal minima agree in by chance; left and right broadcast."""
    x = left ^ right
    differ = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=-1, dtype=np.int64)
    chance = 1 / (1 << LOW_BITS)
    return ((PERMUTATIONS - differ) / PERMUTATIONS - chance) / (1 - chance)


def _binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in arrays], pa.binary())


def _signatures(batches):
    """(id, text) -> (id, n, f1, f2, bands, sig): set size, fingerprint of the set, band keys, packed low bits."""
    tables = Powers()
    for batch in parts(batches):
        n, f1, f2, bands, sigs = [], [], [], [], []
        for s in text_sets(batch.column("text"), tables):
            n.append(len(s))
            with np.errstate(over="ignore"):
                f1.append(int(s.sum(dtype=np.uint64)))
                f2.append(int(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                best = minima(s)
                bands.append(mix64((best.reshape(BANDS, ROWS).astype(np.uint64) * IN_BAND).sum(axis=1, dtype=np.uint64) ^ OF_BAND).view(np.int64) if len(s) else None)
            sigs.append(packed(best))
        longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        keys = pa.array([None if b is None else b.tolist() for b in bands], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), longs(f1), longs(f2), keys, _binary(sigs)], ["id", "n", "f1", "f2", "bands", "sig"])


def _sets(batches):
    tables = Powers()
    for batch in parts(batches):
        yield pa.RecordBatch.from_arrays([batch.column("id"), _binary(list(text_sets(batch.column("text"), tables)))], ["id", "items"])


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < SIMILAR_PERCENT * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared > 0 and 100 * shared >= SIMILAR_PERCENT * (len(both) - shared)


def _estimated(batches):
    for batch in batches:
        as_matrix = lambda k, b=batch: np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint64).reshape(-1, SIG_WORDS)
        keep = estimates(as_matrix("sig"), as_matrix("t")) >= LEAST_ESTIMATE
        yield batch.select(["a", "b", "salt"]).filter(pa.array(keep))


def _confirmed(batches):
    for batch in batches:
        of = lambda name, k, b=batch: np.frombuffer(b.column(name)[k].as_buffer(), np.uint64)
        yield batch.select(["a", "b"]).filter(pa.array([_similar(of("x", k), of("y", k)) for k in range(len(batch))], pa.bool_()))


def _near(batches):
    """Whole groups (key, low, high) of rows (comp, id, sig), sorted by these and side: what the estimate cannot part.

    (a, b): pairs of components, as a forest; (id, null): the rows of such pairs.
    """
    for batch in whole_groups(batches, ("key", "low", "high")):
        key, low, high, side, comp, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "low", "high", "side", "comp", "id"))
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint64).reshape(-1, SIG_WORDS)
        starts, ends = group_starts(key, low, high)
        forest, out, held = Forest(), [], np.zeros(len(ids), bool)

        def joined(a: np.ndarray, b: np.ndarray) -> None:
            a, b = a[comp[a] != comp[b]], b[comp[a] != comp[b]]
            near = estimates(sig[a], sig[b]) >= LEAST_ESTIMATE
            held[a[near]] = held[b[near]] = True
            for x, y in np.unique(np.stack([comp[a[near]], comp[b[near]]], axis=1), axis=0).tolist():
                if forest.join(x, y):
                    out.append((x, y))

        large = ends - starts > SMALL
        for i, j, _ in small_pairs(starts[~large], ends[~large], side, low != high, PAIRS):
            joined(i, j)
        for s, e in zip(starts[large].tolist(), ends[large].tolist(), strict=True):
            rows = np.arange(s, e)
            one, two = (rows, rows) if low[s] == high[s] else (rows[side[s:e] == 0], rows[side[s:e] == 1])
            for i in one:
                joined(np.full(len(two), i), two)
        rows = np.unique(ids[held]).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out] + rows, pa.int64()), pa.array([y for _, y in out] + [None] * len(rows), pa.int64())], ["a", "b"])


def _cross(pdf):
    """Links that are confirmed between components, as a forest.

    pdf: rows of two blocks (side 0 and 1), or of one block met with itself (side 0 alone).
    """
    import pandas as pd

    one, two = pdf[pdf.side == 0], pdf[pdf.side == 1]
    two = one if len(two) == 0 else two
    sig = lambda x: np.frombuffer(b"".join(x.sig), np.uint64).reshape(-1, SIG_WORDS)
    left, right, cl, cr, il, ir = sig(one), sig(two), one.comp.to_numpy(), two.comp.to_numpy(), one.id.to_numpy(), two.id.to_numpy()
    sets = [[np.frombuffer(s, np.uint64) for s in x["items"]] for x in (one, two)]
    forest, out = Forest(), []
    for i in range(len(one)):
        maybe = np.flatnonzero((cr != cl[i]) & (ir != il[i]))
        maybe = maybe[estimates(left[i], right[maybe]) >= LEAST_ESTIMATE]
        for j in maybe:
            a, b = int(cl[i]), int(cr[j])
            if forest.root(a) != forest.root(b) and _similar(sets[0][i], sets[1][j]):
                forest.join(a, b)
                out.append((a, b))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(_signatures), "id long, n long, f1 long, f2 long, bands array<long>, sig binary")


def met_by_hub(pairs: DataFrame, values: DataFrame, name: str, other: str) -> DataFrame:
    """pairs (a, b, salt) with the value (id, name) of a, and that of b as other.

    Many pairs may share a hub b; its value has a copy for each of its salts, so no task meets all of them.
    """
    hubs = values.join(pairs.select(F.col("b").alias("id"), "salt").distinct(), "id").select(F.col("id").alias("b"), "salt", F.col(name).alias(other))
    return pairs.join(values.select(F.col("id").alias("a"), name), "a").join(hubs, ["b", "salt"]).select("a", "b", "salt", name, other)


def confirm(texts: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b, salt) whose full sets are similar, as (a, b). texts: (id, text)."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = scratch.save(texts.join(ids, "id", "left_semi").mapInArrow(lean(_sets), "id long, x binary"), "sets")
    return met_by_hub(pairs, sets, "x", "y").select("a", "b", "x", "y").mapInArrow(lean(_confirmed), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id, kept.

    A null, empty or blank text has n_shingles 0 and is alone in its component. Rows that share an id are one document,
    repeated rows too; of ties the smallest id stands for all. A null id is linked with nothing: component_id null, kept
    true. Ids must be numbers or texts of numbers. Whole texts of any length are compared. An empty table gives an empty
    result. Other columns of docs are neither read nor returned, so their names don't matter.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scratch = Scratch()
    rows = scratch.save(signatures(docs, id_col, text_col), "signatures")
    known = rows.where("n > 0 and id is not null")

    # Classes of equal sets. Lone classes need no row: their documents stand for themselves.
    classes = known.groupBy("f1", "f2", "n").agg(F.min("id").alias("class"), F.count("*").alias("copies")).where("copies > 1")
    member = with_class(rows.select("id", "n", "f1", "f2"), scratch.save(classes, "classes"), ["f1", "f2", "n"])
    member = scratch.save(member.select("id", "n", F.coalesce("class", "id").alias("class")), "members")
    reps = known.join(member.where("n > 0 and id <> class").select("id").distinct(), "id", "left_anti")

    # Buckets with two classes at least.
    entries = reps.select("id", F.explode("bands").alias("key"))
    hubs = entries.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top"), F.count("*").alias("members")).where("hub < top").select("key", "hub", "members")
    entries = scratch.save(entries.join(hubs, "key"), "entries")

    # Each member against the smallest of its bucket.
    pairs = entries.where("id <> hub").groupBy(F.col("id").alias("a"), F.col("hub").alias("b")).agg(F.max("members").alias("members"))
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("members") / PER_HUB)).alias("salt"))
    sig = reps.select("id", "sig")
    pairs = scratch.save(met_by_hub(pairs, sig, "sig", "t").mapInArrow(lean(_estimated), "a long, b long, salt long"), "pairs")
    links = scratch.save(confirm(texts, pairs, scratch), "confirmed")
    found = scratch.save(connected_components(links, scratch), "components")

    # Buckets that still hold several components: which of these might be joined?
    placed = entries.select("id", "key").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", "key", F.coalesce("component", "id").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    open_rows = scratch.save(placed.join(mixed, "key"), "open")
    near = blocked(open_rows.join(sig, "id"), ["key"], 2 * BLOCK).select("key", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"), F.col("side").cast("long").alias("side"), "comp", "id", "sig")
    near = scratch.save(near.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "side").mapInArrow(lean(_near), "a long, b long"), "near")
    groups = connected_components(near.where("b is not null"), scratch)
    waiting = open_rows.join(near.where("b is null").select(F.col("a").alias("id")).distinct(), "id", "left_semi").select("id", "comp").distinct()
    waiting = scratch.save(waiting.join(groups.select(F.col("node").alias("comp"), F.col("component").alias("grp")), "comp"), "waiting")
    if not waiting.isEmpty():
        sets = texts.join(waiting.select("id").distinct(), "id", "left_semi").mapInArrow(lean(_sets), "id long, items binary")
        held = blocked(waiting.join(sig, "id").join(sets, "id"), ["grp"], BLOCK, F.octet_length("items"), BLOCK_BYTES)
        more = held.groupBy("grp", "low", "high").applyInPandas(_cross, "a long, b long")
        links = links.select("a", "b").unionAll(more)
        found = connected_components(links.unionAll(found.select(F.col("node").alias("a"), F.col("component").alias("b"))), scratch)

    out = member.join(found.select(F.col("node").alias("class"), "component"), "class", "left")
    alone = F.col("n") == 0
    component = F.when(alone, F.col("id")).otherwise(F.coalesce("component", "class"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return scratch.result(out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))), "duplicates")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but the first document of each component (see near_duplicates).

    Every column of docs is kept, whatever its name; rows without an id, without words, and repeated rows of a kept id stay.
    """
    gone = fresh(docs, "gone")
    away = near_duplicates(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias(gone)).distinct()
    # How many go grows with docs, so they are met by a merge at every size.
    return docs.join(away.hint("merge"), docs[id_col].cast("long") == F.col(gone), "left_anti")
