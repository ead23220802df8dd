"""The driver's tables as the engine's inputs. Each adapter has the same form in SQL (oracle.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem.operators import lines as L
from xylem.operators import series as S

#: Lines of an image of the canvas.
ROWS = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, r, v): each embedding as a series."""
    return S.explode_series(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines (image_id, y, g): fifty embeddings make an image, stretched to whole numbers from 0 to 255."""
    e = table(spark, sf_dir, "embeddings")
    raw = e.select(F.expr(f"vec_id div {ROWS}").alias("image_id"), (F.col("vec_id") % ROWS).cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("g"))
    return L.minmax(raw)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, value binary): orders as job messages; some have no metadata, or a coordinate missing."""
    k = F.col("o_orderkey")
    coordinate = lambda m, n: F.when(k % m != 0, (k % n).cast("double"))
    metadata = F.when(k % 13 != 0, F.struct(coordinate(7, 100).alias("coordinatesX"), coordinate(11, 90).alias("coordinatesY")))
    job = F.struct(F.concat(F.lit("job-"), k).alias("jobId"), F.concat(F.lit("img/"), F.col("o_custkey"), F.lit(".png")).alias("file"), F.col("o_orderpriority").alias("clientId"), metadata.alias("metadata"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(job).cast("binary").alias("value"))


def sidecar(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Images (documents) and the side table that holds only some of them (labels)."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), table(spark, sf_dir, "labels")
