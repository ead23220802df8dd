"""Near-duplicates of embeddings by p-stable hashing.

Unit vectors are projected on random Gaussian directions; the quantised projections of one table make a bucket key
that also holds the label and the length of the vector. Every pair that shares a bucket is checked by exact cosine.
With a width of 1.5, 12 projections and 28 tables a pair of cosine 0.98 (distance 0.2) meets with a probability of
0.9998. A pair is counted only in the first table in which it meets, which its two rows of keys tell without any
shuffle: counts and a spanning forest leave a task, never the pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.common import Forest, Scratch, blocked, connected_components, group_starts, lean, mix64, small_pairs, whole_groups, with_class

LEAST_COSINE = 0.98
TABLES, PROJECTIONS, WIDTH = 28, 12, 1.5
#: Vectors of one block; a task compares two blocks.
BLOCK = 512
#: Groups of no more rows are compared pair by pair, many groups at once; so many pairs at a time.
SMALL, PAIRS = 48, 1 << 16
SEED = 4242


def _directions(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.standard_normal((dim, TABLES * PROJECTIONS)), rng.random(TABLES * PROJECTIONS) * WIDTH


def bucket_keys(unit: np.ndarray, space: int) -> np.ndarray:
    """A key for each row and table. space: a hash of what must be equal besides."""
    along, shift = _directions(unit.shape[1])
    cell = np.floor((unit @ along + shift) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(unit), TABLES, PROJECTIONS)
    key = mix64(np.full((len(unit), TABLES), space, np.uint64) ^ mix64(np.arange(1, TABLES + 1, dtype=np.uint64)))
    for j in range(PROJECTIONS):
        key = mix64(key + cell[:, :, j])
    return key.view(np.int64)


def _prepared(batches):
    """(id, label, vec) -> (id, fp, raw, keys): hash of label and vector, doubles, bucket keys; nulls for what links with nothing."""
    for batch in batches:
        ids, labels, vecs = (batch.column(k).to_pylist() for k in ("id", "label", "vec"))
        fps, raws, keys = ([None] * len(ids) for _ in range(3))
        groups: dict[tuple, list[int]] = {}
        for i, (label, vec) in enumerate(zip(labels, vecs, strict=True)):
            if ids[i] is None or label is None or not vec or None in vec:
                continue
            x = np.array(vec, np.float64)
            if not np.isfinite(x).all() or not x.any():
                continue
            raws[i] = x
            groups.setdefault((label, len(x)), []).append(i)
        for (label, dim), at in groups.items():
            x = np.array([raws[i] for i in at])
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            space = hashlib.blake2b(f"{label}/{dim}".encode(), digest_size=8).digest()
            for i, k in zip(at, bucket_keys(x, int.from_bytes(space, "little")), strict=True):
                keys[i] = k.tobytes()
                fps[i] = hashlib.blake2b(space + raws[i].tobytes(), digest_size=16).digest()
                raws[i] = raws[i].tobytes()
        binary = lambda x: pa.array(x, pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), binary(fps), binary(raws), binary(keys)], ["id", "fp", "raw", "keys"])


def _keys_of(batches):
    for batch in batches:
        n = len(batch)
        keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(batch.column("id").to_pylist(), np.int64), TABLES)), pa.array(keys)], ["id", "key"]) if n else pa.RecordBatch.from_pylist([], pa.schema([("id", pa.int64()), ("key", pa.int64())]))


def scaled(raw: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near 1: exact, and no square overflows or vanishes."""
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1))[1][:, None])


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def pair_cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with that of y, in double precision: what a link is decided by."""
    return (x * y).sum(axis=1) / (lengths(x) * lengths(y))


def linked(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which rows are linked, as a matrix; what the product leaves within rounding is decided pair by pair."""
    c = (left @ right.T) / (lengths(left)[:, None] * lengths(right)[None, :])
    out = c >= LEAST_COSINE
    i, j = np.nonzero(np.abs(c - LEAST_COSINE) < 1e-9)
    out[i, j] = pair_cosines(left[i], right[j]) >= LEAST_COSINE
    return out


def _components_of(link: np.ndarray) -> np.ndarray:
    """The first row of each row's component in a symmetric matrix of links."""
    root, n = np.full(len(link), -1), len(link)
    for i in range(n):
        if root[i] >= 0:
            continue
        edge = np.zeros(n, bool)
        edge[i] = True
        while edge.any():
            root[edge] = i
            edge = link[edge].any(axis=0) & (root < 0)
    return root


def _dense(raw, keys, copies, ids, one, two, table, found, edges) -> None:
    """A large group: all cosines of rows `one` with rows `two` (the same rows, or others) as a matrix."""
    link = linked(raw[one], raw[two])
    link &= ids[one][:, None] != ids[two][None, :]
    for t in range(table):
        link &= keys[one][:, t, None] != keys[two][None, :, t]
    found[one] += link @ copies[two]
    if one is two:
        root = _components_of(link)
        rows = one
    else:
        found[two] += link.T @ copies[one]
        whole = np.zeros((len(one) + len(two),) * 2, bool)
        whole[: len(one), len(one) :] = link
        root, rows = _components_of(whole | whole.T), np.concatenate([one, two])
    on = np.flatnonzero(root != np.arange(len(root)))
    edges.append(np.stack([rows[on], rows[root[on]]], axis=1))


def _sparse(raw, keys, copies, ids, a, b, table, found, edges) -> None:
    """Pairs of rows of small groups, and the table of each."""
    first = (keys[a] == keys[b]).argmax(axis=1) == table
    a, b = a[first], b[first]
    near = (pair_cosines(raw[a], raw[b]) >= LEAST_COSINE) & (ids[a] != ids[b])
    a, b = a[near], b[near]
    np.add.at(found, a, copies[b])
    np.add.at(found, b, copies[a])
    forest = Forest()
    edges.append(np.array([(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if forest.join(x, y)], np.int64).reshape(-1, 2))


def _met(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Whole groups (key, low, high), sorted by these and side: rows (id, found, root) of the links that are first met here."""
    column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
    ids, copies, key, low, high, side = (column(c) for c in ("id", "copies", "key", "low", "high", "side"))
    found, edges = np.zeros(len(ids), np.int64), []
    keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64).reshape(len(ids), TABLES)
    values = batch.column("raw").to_pylist()
    width = max(map(len, values))  # vectors of other lengths never share a group
    raw = scaled(np.frombuffer(b"".join(x.ljust(width, b"\0") for x in values), np.float64).reshape(len(ids), -1))
    starts, ends = group_starts(key, low, high)
    table = (keys[starts] == key[starts, None]).argmax(axis=1)
    large = ends - starts > SMALL
    for s, e, t in zip(starts[large].tolist(), ends[large].tolist(), table[large].tolist(), strict=True):
        rows = np.arange(s, e)
        one, two = (rows, rows) if low[s] == high[s] else (rows[side[s:e] == 0], rows[side[s:e] == 1])
        if len(one) and len(two):
            _dense(raw, keys, copies, ids, one, two, t, found, edges)
    for i, j, group in small_pairs(starts[~large], ends[~large], side, low != high, PAIRS):
        _sparse(raw, keys, copies, ids, i, j, table[~large][group], found, edges)
    pairs = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
    counted = np.flatnonzero(found)
    out_id, out_root = np.concatenate([ids[counted], ids[pairs[:, 0]]]), np.concatenate([ids[counted], ids[pairs[:, 1]]])
    return pa.RecordBatch.from_arrays([pa.array(out_id), pa.array(np.concatenate([found[counted], np.zeros(len(pairs), np.int64)])), pa.array(out_root)], ["id", "found", "root"])


def _linked(batches):
    for groups in whole_groups(batches, ("key", "low", "high")):
        yield _met(groups)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of vectors: id_col, n_links, component_id, kept.

    Links join rows of equal, non-null label and length whose cosine in double precision is 0.98 or more. A vector
    that is null, empty, zero or holds a null or non-finite component has no link, and so has one without an id (its
    component is null, kept true). Equal vectors form a class, so a hot vector costs as much as a rare one; they and
    repeated rows are linked to each other, and of ties the smallest id names a component. Rows that share an id but
    differ otherwise count as one node. Ids must be numbers or texts of numbers. An empty table gives an empty result.
    Other columns are neither read nor returned, so their names don't matter.
    """
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    scratch = Scratch()
    rows = scratch.save(source.mapInArrow(lean(_prepared), "id long, fp binary, raw binary, keys binary"), "vectors")
    known = rows.where("fp is not null")
    classes = known.groupBy("fp").agg(F.min("id").alias("class"), F.count("*").alias("copies"))
    member = with_class(rows.select("id", "fp"), scratch.save(classes.where("copies > 1"), "classes"), ["fp"])
    member = scratch.save(member.select("id", F.coalesce("class", "id").alias("class"), F.coalesce("copies", F.lit(1)).alias("copies")), "members")
    reps = known.join(member.where("id <> class").select("id").distinct(), "id", "left_anti")
    sizes = member.groupBy(F.col("class").alias("id")).agg(F.max("copies").alias("copies"))

    entries = reps.select("id", "keys").mapInArrow(lean(_keys_of), "id long, key long")
    shared = entries.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    entries = entries.join(shared, "key").join(reps.select("id", "raw", "keys"), "id").join(sizes, "id")
    blocks = blocked(entries, ["key"], BLOCK).repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "side", "id")
    blocks = blocks.select("key", "low", "high", F.col("side").cast("long").alias("side"), "id", F.col("copies").cast("long").alias("copies"), "raw", "keys")
    met = scratch.save(blocks.mapInArrow(lean(_linked), "id long, found long, root long"), "met")
    counts = met.groupBy("id").agg(F.sum("found").alias("found"))
    parts = connected_components(met.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)

    out = member.join(counts.withColumnRenamed("id", "class"), "class", "left").join(parts.select(F.col("node").alias("class"), "component"), "class", "left")
    out = out.select(F.col("id").alias(id_col), (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class").alias("component_id"))
    return scratch.result(out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))), "duplicates")
