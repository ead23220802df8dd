"""Job messages, results and the lookups beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xylem import schemas
from xylem.functions.columns import status_of


def parse_messages(raw: DataFrame, value: str = "value") -> DataFrame:
    """The message's columns beside those of raw; what is not a message is kept, all null, its text in `corrupt`."""
    text = F.col(value).cast("string")
    kept = [c for c in raw.columns if c != value]
    parsed = raw.select(*kept, text.alias("__text"), F.from_json(text, schemas.MESSAGE).alias("__m"))
    corrupt = F.when(F.col("__m").isNull() | F.coalesce(F.col("__m.jobId"), F.col("__m.file")).isNull(), F.col("__text"))
    return parsed.select(*kept, "__m.*", corrupt.alias("corrupt"))


def with_coordinates(jobs: DataFrame) -> DataFrame:
    """x and y, each 0 where it is missing."""
    return jobs.withColumns({"x": F.coalesce("metadata.coordinatesX", F.lit(0.0)), "y": F.coalesce("metadata.coordinatesY", F.lit(0.0))})


def lookup(left: DataFrame, right: DataFrame, key: str, found: str, missing: str) -> DataFrame:
    """left with what right has for its key, and a status: a miss is a status row, never a drop. Spark broadcasts right if it is small."""
    joined = left.join(right.withColumn("__hit", F.lit(True)), key, "left")
    return joined.withColumn("status", F.when(F.col("__hit"), F.lit(found)).otherwise(F.lit(missing))).drop("__hit")


def classify(rows: DataFrame, message: str = "message") -> DataFrame:
    return rows.withColumn("status", status_of(F.col(message)))


def envelope(job: Column, client: Column, url: Column, x: Column, y: Column, results: Column, error: Column, when: Column) -> Column:
    """The result as a struct; an error makes it FAILED and leaves data null."""
    metadata = F.struct(x.alias("coordinatesX"), y.alias("coordinatesY"))
    data = F.when(error.isNull(), F.struct(url.alias("originalUrl"), metadata.alias("metadata"), results.alias("results")))
    return F.struct(job.alias("jobId"), client.alias("clientId"), F.when(error.isNull(), "COMPLETED").otherwise("FAILED").alias("status"), when.alias("timestamp"), data.alias("data"), error.alias("error"))


def to_message(result: Column) -> Column:
    """JSON with its nulls."""
    return F.to_json(result, {"ignoreNullFields": "false"})


def reconcile(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, expected, actual, complete) of counts by key."""
    e, a = expected.groupBy(key).agg(F.count("*").alias("expected")), actual.groupBy(key).agg(F.count("*").alias("actual"))
    return e.join(a, key, "left").select(key, "expected", F.coalesce("actual", F.lit(0).cast("long")).alias("actual")).withColumn("complete", F.col("expected") == F.col("actual"))


def first_and_last(rows: DataFrame, order: str, n: int = 10) -> DataFrame:
    """The first and the last n rows by a unique key: two bounded sorts, no window over all."""
    first, last = rows.orderBy(order).limit(n).withColumn("place", F.lit("first")), rows.orderBy(F.col(order).desc()).limit(n).withColumn("place", F.lit("last"))
    return first.unionAll(last)


def expected_slices(images: int, low: int = 3, high: int = 30, label_bytes: int = 100) -> dict[str, int]:
    """How many slice files a run will make, and about how many bytes of labels."""
    n = images * sum(range(low, high + 1))
    return {"files": n, "label_bytes": n * label_bytes}
