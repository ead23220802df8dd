"""What several operators share: tables in the shared folder, hashing of word sequences, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel handles at once (a longer text is handled alone).
CHUNK_BYTES = 1 << 20
#: Rows of a batch whose results a kernel holds at once.
PART_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, one of our own in local mode, where there is but one machine; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="xylem-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends here, and any executor may go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/xylem/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    for held in _HELD:
        held.append(out)
    return out


_HELD: list[list[DataFrame]] = []


@contextlib.contextmanager
def temporary():
    """Tables that save() makes within are deleted at the end, but for those that the caller takes out of the list it is given."""
    made: list[DataFrame] = []
    _HELD.append(made)
    try:
        yield made
    finally:
        _HELD.remove(made)
        for table in made:
            discard(table)


def discard(df: DataFrame) -> None:
    """Deletes a table that save() made and that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(df.saved_path)
    path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    name, taken = stem, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """Tables of one operator: result() writes what it returns and deletes the others."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(save(df, name))
        return self.tables[-1]

    def clear(self) -> None:
        for table in self.tables:
            discard(table)
        self.tables = []

    def result(self, df: DataFrame, name: str) -> DataFrame:
        out = save(df, name)
        self.clear()
        return out


#: A class with more rows than a so small part of a task's even share is met where its rows are.
SPLIT = 4


def with_class(rows: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    """rows with what classes (keys, copies, ...) says of their keys, or nulls.

    Classes of very many copies, fewer than SPLIT times the tasks, go out to all rows, so that no task gathers one;
    the others meet their rows by key.
    """
    share = (classes.agg(F.sum("copies")).first()[0] or 0) / (SPLIT * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = F.broadcast(classes.where(F.col("copies") > share))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(classes.where(F.col("copies") <= share), keys, "left")
    return rows.join(hot, keys).unionByName(rest)


def connected_components(edges: DataFrame, scratch: Scratch | None = None, max_rounds: int = 60) -> DataFrame:
    """(a, b) links of longs -> (node, component), the smallest node reachable.

    Alternates large-star and small-star steps; each step is a partial minimum and an equi-join,
    so a hub's links are never gathered in one task (the join's skew is split by adaptive execution).
    Self links and nulls are left out; an empty table gives an empty result.
    """
    links = save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    for _ in range(max_rounds):
        # Done when all links are stars: no node has two parents, or a parent and a child.
        ends = links.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(links.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty():
            break
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after = save(small, "links")
        discard(links)
        links = after
    else:
        raise RuntimeError(f"links are not settled after {max_rounds} rounds")
    if scratch:
        scratch.tables.append(links)
    roots = links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


# --- word sequences as 64-bit hashes, vectorised over a batch of texts ---

_RNG = np.random.default_rng(20_240_229)
BYTE_HASH = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
POWER = np.uint64(0x9E3779B97F4A7C15 & ~7 | 5)
POWER_INV = np.uint64(pow(int(POWER), -1, 2**64))
PLACE = _RNG.integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of [\x20\x09-\x0D], which part words.
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
BYTE_HASH[BLANK] = 0


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Powers:
    """Powers of POWER and of its inverse, grown when a longer text comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, CHUNK_BYTES + 1)
            self.up, self.down = powers(POWER, n), powers(POWER_INV, n)
        return self.up, self.down


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and where each text begins (one more entry: the end); a null is empty."""
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def lean(kernel):
    """The kernel of a mapInArrow, whose memory goes back to the system when its task ends: idle workers count against their executor."""

    def run(batches):
        yield from kernel(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # a C library that has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return run


def parts(batches):
    """The batches in slices, so that what a kernel makes of one does not grow with the batch."""
    for batch in batches:
        for k in range(0, len(batch), PART_ROWS):
            yield batch.slice(k, PART_ROWS)


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Ranges of rows of at most `most` bytes together, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(body: np.ndarray, offsets: np.ndarray, tables: Powers, lower: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first byte of each word of the texts, and how many words stand before each text."""
    n = len(body)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    up, down = tables.get(n)
    folded = lower[body]
    solid = ~BLANK[body]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cut = offsets[:-1][offsets[:-1] < n]
    first[cut] = solid[cut]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cut = offsets[1:][offsets[1:] > 0] - 1
    last[cut] = solid[cut]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    run = BYTE_HASH[folded]
    run *= up[:n]
    np.cumsum(run, out=run)
    before = np.where(starts > 0, run[starts - 1], np.uint64(0))
    return mix64((run[ends] - before) * down[starts]), starts, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every `size` words in a row, by its first word; shorter than that: of the whole sequence."""
    n = len(words)
    if n == 0:
        return words
    if n < size:
        return mix64((words * PLACE[:n]).sum(keepdims=True) + PLACE[15:] * np.uint64(n))
    total = np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        total += words[j : n - size + 1 + j] * PLACE[j]
    return mix64(total)


# --- groups of rows, compared in blocks ---


class Forest:
    """Union of small sets of numbers within a task."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def blocked(rows: DataFrame, group: list[str], size: int, weight=None, most: int = 1) -> DataFrame:
    """Each row once for every pair of blocks that its own block is in; blocks cut a group evenly by a hash of the id, into about `size` rows and, by their weights, `most` at most."""
    parts = F.ceil(F.count("*") / size)
    parts = parts if weight is None else F.greatest(parts, F.ceil(F.sum(weight) / most))
    counts = rows.groupBy(*group).agg(F.count("*").alias("members"), parts.cast("int").alias("blocks")).where("members > 1")
    rows = rows.join(counts, group)
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}).drop("members", "blocks", "own", "other")


def whole_groups(batches, columns: tuple[str, ...]):
    """Batches of sorted rows, cut anew so that none ends within a group of equal columns."""
    rest: list[pa.RecordBatch] = []
    glued = lambda parts: pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    for batch in batches:
        if not len(batch):
            continue
        values = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if rest and any(rest[-1].column(c)[-1].as_py() != v[0] for c, v in zip(columns, values, strict=True)):
            yield glued(rest)
            rest = []
        other = np.flatnonzero(np.logical_or.reduce([v != v[-1] for v in values]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield glued([*rest, batch.slice(0, cut)])
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield glued(rest)


def group_starts(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group of equal rows begins and ends."""
    new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    starts = np.flatnonzero(np.concatenate([[True], new]))
    return starts, np.append(starts[1:], len(columns[0]))


def small_pairs(starts: np.ndarray, ends: np.ndarray, side: np.ndarray, cross: np.ndarray, most: int):
    """(row, row, group) arrays of at most about `most` pairs: all pairs of each group, or, where cross, those of side 0 with side 1 (rows sorted by side)."""
    if not len(starts):
        return
    group = np.repeat(np.arange(len(starts)), ends - starts)
    rows = np.concatenate([np.arange(s, e) for s, e in zip(starts, ends, strict=True)])
    ones = np.concatenate([[0], np.cumsum(side[rows] == 0)])
    offset = np.concatenate([[0], np.cumsum(ends - starts)])
    zeros = ones[offset[1:]] - ones[offset[:-1]]
    first = np.where(cross[rows], starts[group] + zeros[group], rows + 1)
    count = np.where(cross[rows] & (side[rows] != 0), 0, ends[group] - first)
    total = np.cumsum(count)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        n = count[at:to]
        i = np.repeat(rows[at:to], n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:to], n)
        yield i, j, np.repeat(group[at:to], n)
        at = to
