"""Ring annotations: shapes of points, their segments, and sums by shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def explode_points(rows: DataFrame) -> DataFrame:
    """(image_id, shape, point, x, y) of (image_id, shapes): whole numbers, cut towards zero; a shape without points has no row."""
    shapes = rows.select("image_id", F.posexplode("shapes").alias("shape", "s"))
    points = shapes.select("image_id", "shape", F.posexplode("s.points").alias("point", "p"))
    return points.select("image_id", "shape", "point", F.get("p", F.lit(0)).cast("int").alias("x"), F.get("p", F.lit(1)).cast("int").alias("y"))


def segments(points: DataFrame) -> DataFrame:
    """Each point with the next one (x2, y2); the last of a shape goes back to its first."""
    shape = W.partitionBy("image_id", "shape").orderBy("point")
    first = lambda c: F.first(c).over(shape.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return points.withColumns({f"{c}2": F.coalesce(F.lead(c).over(shape), first(c)) for c in ("x", "y")})


def shape_summary(points: DataFrame) -> DataFrame:
    """(image_id, shape, vertices, perimeter)."""
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    return segments(points).groupBy("image_id", "shape").agg(F.count("*").alias("vertices"), F.sum(F.sqrt((dx * dx + dy * dy).cast("double"))).alias("perimeter"))


def annotation_status(images: DataFrame, points: DataFrame) -> DataFrame:
    """(image_id, rings, status): images without annotations are a WARNING."""
    rings = points.groupBy("image_id").agg(F.countDistinct("shape").alias("rings"))
    out = images.join(rings, "image_id", "left")
    return out.withColumn("status", F.when(F.col("rings") > 0, F.lit("SUCCESS")).otherwise(F.lit("WARNING: no rings"))).withColumn("rings", F.coalesce("rings", F.lit(0).cast("long")))
