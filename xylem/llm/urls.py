"""URL filters as a temporal list join, in DataFrame functions only.

Dated list entries (a key is added to a list, or removed from it) become validity intervals; every capture is judged by
the intervals that hold at its fetch time. A key is a domain, which covers its subdomains, or a host with the first
segment of a path. The join is on the key, with the time as a further condition; what matches is summed up by capture.
A key that many captures have is salted on both sides, the more the larger its share, so that a host with a third of all
captures is met in a third of all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A key with more than so small a part of a task's even share of the captures' keys is split.
SPLIT = 4


def host_of(url: Column) -> Column:
    """Lower-case host of a URL with a scheme, without user and port; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def keys_of(url: Column) -> Column:
    """The host, its parent domains, and the host with the path's first segment."""
    host, labels = host_of(url), F.split(host_of(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segment = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+/([^/?#]+)", 1)
    return F.when(host.isNotNull(), F.concat(domains, F.when(segment != "", F.array(F.concat(host, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, action, listed) -> (list, key, valid_from, valid_to): from each `add` to the key's next entry; null: still valid.

    At one instant a removal comes after an addition, and an interval of no length is none. Entries with a null key,
    list or time are left out.
    """
    rows = entries.select("list", F.lower("key").alias("key"), "action", "listed").where("list is not null and key is not null and listed is not null").distinct()
    after = F.lead("listed").over(W.partitionBy("list", "key").orderBy("listed", "action"))
    rows = rows.withColumn("valid_to", after).where("action = 'add' and (valid_to is null or valid_to > listed)")
    return rows.select("list", "key", F.col("listed").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """One row per row of captures: id_col, host, time_col, blocked (0/1), n_entries, list, key, valid_from.

    list, key and valid_from are of the longest matching key (ties: the last in order). A capture without a host or
    time, with a null or empty url, or beside empty lists, is not blocked. Repeated rows and null ids are judged each, URLs
    of any length whole. An empty table gives an empty result. Other columns are not read, so their names don't matter.
    """
    rows = captures.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("time"))
    spread = rows.select("row", "id", host_of(F.col("url")).alias("host"), "time", F.explode_outer(keys_of(F.col("url"))).alias("key"))
    counts = spread.where("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    share = (counts.agg(F.sum("n")).first()[0] or 0) / (SPLIT * int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Fewer keys than SPLIT times the tasks hold more than that share, so these may be sent to all.
    hot = F.broadcast(counts.where(F.col("n") > share).select(F.col("key").alias("hot"), F.ceil(F.col("n") / max(share, 1.0)).alias("salts")))
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    spread = spread.join(hot, F.col("key") == F.col("hot"), "left").select("row", "id", "host", "time", "key", F.pmod(F.xxhash64("row"), salts).alias("salt"))
    valid = intervals(entries).join(hot, F.col("key") == F.col("hot"), "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    valid = valid.select(F.col("key").alias("listed_key"), F.col("salt").alias("listed_salt"), "list", "valid_from", "valid_to")
    on = (F.col("key") == F.col("listed_key")) & (F.col("salt") == F.col("listed_salt")) & (F.col("valid_from") <= F.col("time")) & (F.col("valid_to").isNull() | (F.col("time") < F.col("valid_to")))
    met = spread.join(valid, on, "left")
    best = F.max(F.when(F.col("listed_key").isNotNull(), F.struct(F.length("key"), "key", "list", "valid_from")))
    out = met.groupBy("row", "id", "host", "time").agg(F.count("listed_key").alias("n_entries"), best.alias("best"))
    return out.select(F.col("id").alias(id_col), "host", F.col("time").alias(time_col), (F.col("n_entries") > 0).cast("int").alias("blocked"), "n_entries", F.col("best.list").alias("list"), F.col("best.key").alias("key"), F.col("best.valid_from").alias("valid_from"))
