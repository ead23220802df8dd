"""Shards along a Hilbert curve through the documents' metadata.

Each dimension (a number or a string) is cut at its own quantiles into 2^BITS cells; a cell's place
on the Hilbert curve, then the text's hash and the id, is the order. Runs of that order make the shards, so a shard's
files span short ranges in every dimension at once and their minima and maxima prune; equal texts of equal metadata
lie side by side. No key is gathered: the order is a range partitioning that also cuts by id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from xylem.llm.common import Scratch, discard, fresh, save

BITS = 5
SHARDS = 16


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the curve of each row of cell numbers (unsigned, `bits` bits each), by the transposed-axes method."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i in range(n):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(on, x[0] ^ below, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    fix = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        fix = np.where((x[n - 1] & (1 << level)) != 0, fix ^ ((1 << level) - 1), fix)
    x ^= fix
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> level) & 1)
    return out


def as_number(c: Column) -> Column:
    """A number as double; null below all."""
    return F.coalesce(c.cast("double"), F.lit(-float("inf")))


def string_cuts(rows: DataFrame, name: str, cells: int) -> list[str]:
    """The first value of each of about `cells` runs of equal weight of a string column, in code point order; nulls are left out.

    Values are counted, then ordered by a range partitioning; one sum a partition and one value a run come to the driver.
    """
    counts = rows.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count("*").alias("n"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = counts.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id())
    placed = save(placed.withColumn("upto", F.sum("n").over(W.partitionBy("part").orderBy("v"))), "values")
    total, before = 0, [(-1, 0)]
    for part, n in sorted((r.part, r["upto"]) for r in placed.groupBy("part").agg(F.max("upto").alias("upto")).collect()):
        before.append((part, total))
        total += n
    starts = rows.sparkSession.createDataFrame(before, "part int, before long")
    cell = F.expr(f"((before + upto - n) * {cells}L) div {max(total, 1)}L")
    cuts = sorted(r.v for r in placed.join(F.broadcast(starts), "part").groupBy(cell.alias("cell")).agg(F.min("v").alias("v")).collect())
    discard(placed)
    return cuts


def _placed(docs: DataFrame, dims: tuple[str, ...], id_col: str, text_col: str, shards: int, key: Column) -> DataFrame:
    """(id, key, size, crc, curve, shard, slot) of each row."""
    kinds = dict(docs.dtypes)
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    values = [F.col(c) if kinds[c] == "string" else as_number(F.col(c)) for c in dims] + [F.log2(size)]
    slim = save(docs.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), size.alias("size"), crc.alias("crc"), *[x.alias(f"x{i}") for i, x in enumerate(values)]), "sizes")
    texts = [i for i, c in enumerate(dims) if kinds[c] == "string"]
    numbers = [i for i in range(len(values)) if i not in texts]
    share = F.array(*[F.lit(k / (1 << BITS)) for k in range(1, 1 << BITS)])
    found = slim.agg(*[F.percentile_approx(f"x{i}", share, 10_000).alias(f"x{i}") for i in numbers]).first()
    cuts = {i: sorted(set(found[f"x{i}"] or [])) for i in numbers} | {i: string_cuts(slim, f"x{i}", (1 << BITS) - 1) for i in texts}

    @F.pandas_udf("long")
    def curve(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(cells.to_numpy(), BITS))

    def cell(i: int) -> Column:
        """How many cuts are below a number, or not above a string (null: none)."""
        if not cuts[i]:
            return F.lit(0)
        known = F.array(*map(F.lit, cuts[i]))
        return F.size(F.filter(known, (lambda c: F.coalesce(c <= F.col(f"x{i}"), F.lit(False))) if i in texts else (lambda c: c < F.col(f"x{i}"))))

    keyed = slim.withColumn("curve", curve(F.struct(*[cell(i).alias(f"c{i}") for i in range(len(values))]))).select("id", "key", "size", "crc", "curve")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["curve", "crc", "id", "size", "key"]
    placed = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = save(placed, "placed")
    discard(slim)
    placed = placed.withColumns({"part": F.shiftright("at", 33), "nth": F.col("at").bitwiseAND((1 << 33) - 1)})
    counts = sorted((r.part, r["n"]) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())  # one number a partition
    total, before = 0, {}
    for part, n in counts:
        before[part] = total
        total += n
    starts = docs.sparkSession.createDataFrame(list(before.items()), "part long, before long")
    out = placed.join(F.broadcast(starts), "part").withColumn("rank", F.col("before") + F.col("nth"))
    # shard s begins at ceil(s * total / shards)
    out = out.withColumn("shard", F.expr(f"(rank * {shards}) div {max(total, 1)}").cast("int"))
    return out.withColumn("slot", F.col("rank") - F.expr(f"(shard * bigint({total}) + {shards - 1}) div {shards}")).select("id", "key", "size", "crc", "curve", "shard", "slot")


def hilbert_shards(docs: DataFrame, dims: tuple[str, ...] = ("lang", "source"), id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per row of docs: id_col, size, text_crc32, law, shard, slot, grown_shard (null), curve.

    size is the whole text's UTF-8 bytes (null or empty: none) plus 1 and is a dimension too, by its logarithm; dims are
    columns of numbers or strings. Law `rows`: the counts of the shards are one apart at most; slots of a shard go from 0
    without a gap. A null dimension is a value below all. Repeated rows, null ids and ties have places of their own; ids
    must be numbers or texts of numbers. An empty table gives an empty result. Other columns are not read, so their
    names don't matter.
    """
    out = _placed(docs, dims, id_col, text_col, shards, F.lit(0).cast("long"))
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, dims: tuple[str, ...] = ("lang", "source"), id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> str:
    """Writes docs as Parquet folders, one a shard, each in curve order, and returns the folders' column: `shard`, or that with _ where docs has one.

    Each row goes by a key of its own, so null and repeated ids are written as they are, with all columns of docs.
    """
    scratch = Scratch()
    key, shard, slot = fresh(docs, "key"), fresh(docs, "shard"), fresh(docs, "slot")
    rows = scratch.save(docs.withColumn(key, F.monotonically_increasing_id()), "shard_rows")
    places = _placed(rows, dims, id_col, text_col, shards, F.col(key)).select(F.col("key").alias(key), F.col("shard").alias(shard), F.col("slot").alias(slot))
    out = rows.join(places, key).repartitionByRange(shards * 4, shard, slot).sortWithinPartitions(shard, slot)
    out.select(*docs.columns, shard).write.partitionBy(shard).parquet(path)
    scratch.clear()
    return shard
