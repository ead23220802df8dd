"""Radial profiles, polar sectors and angular slices of images held as lines.

The grid of rays is the same for all images, of a size set by the caller, and so is broadcast; lines meet it by y, and
sums by radius are formed before anything is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ray_grid(spark: SparkSession, cx: float, cy: float, radii: range, angles: int = 360, truncate: bool = True) -> DataFrame:
    """(t, r, x, y): where each ray meets the image; truncated towards zero, or the nearest pixel."""
    grid = spark.range(angles).select(F.col("id").cast("int").alias("t"), F.explode(F.sequence(F.lit(radii.start), F.lit(radii.stop - 1))).alias("r")) if len(radii) else spark.range(0).select(F.col("id").cast("int").alias("t"), F.col("id").cast("int").alias("r"))
    angle = F.col("t") * (2 * math.pi) / angles
    whole = (lambda c: F.floor(c).cast("int")) if not truncate else (lambda c: c.cast("int"))
    shift = 0.5 if not truncate else 0.0
    return grid.select("t", "r", whole(F.col("r") * F.cos(angle) + (cx + shift)).alias("x"), whole(F.col("r") * F.sin(angle) + (cy + shift)).alias("y"))


def sampled(lines: DataFrame, grid: DataFrame) -> DataFrame:
    """(image_id, t, r, v): the value under each sample that lies within the image; an image that no ray meets has a row of nulls."""
    met = lines.join(F.broadcast(grid), "y", "left").withColumn("__in", (F.col("x") >= 0) & (F.col("x") < F.size("g")))
    inside = lambda c: F.when(F.col("__in"), c)
    return met.select("image_id", inside(F.col("t")).alias("t"), inside(F.col("r")).alias("r"), inside(F.get("g", F.col("x"))).alias("v"))


def ray_profile(lines: DataFrame, cx: float, cy: float, radii: range, angles: int = 360) -> DataFrame:
    """(image_id, r, v): the mean over all rays, a sample outside counting as 0.

    Sums by radius leave the scan; only they are shuffled, and gathered by image for the radii that no ray met.
    """
    sums = sampled(lines, ray_grid(lines.sparkSession, cx, cy, radii, angles)).groupBy("image_id", "r").agg(F.sum("v").alias("s"))
    held = sums.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("r").isNotNull(), F.struct("r", "s")))).alias("m"))
    every = F.sequence(F.lit(radii.start), F.lit(radii.stop - 1)) if len(radii) else F.array().cast("array<int>")
    return held.select("image_id", F.explode(F.transform(every, lambda r: F.struct(r.alias("r"), (F.coalesce(F.try_element_at("m", r), F.lit(0.0)) / angles).alias("v")))).alias("z")).select("image_id", "z.*")


def polar(lines: DataFrame, cx: float, cy: float, max_radius: int, angles: int = 360) -> DataFrame:
    """(image_id, r, a): at each radius the values by angle, of the nearest pixels; what lies outside the image is 0.

    An image's lines (0, 1, 2 ..., none missing) are gathered in one row, where any pixel is reached by its place: no
    join, and no row for a sample.
    """
    held = lines.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("y", "g"))).alias("p")).select("image_id", F.col("p.g").alias("m"))

    def value(r: Column, t: Column) -> Column:
        angle = t * (2 * math.pi) / angles
        x, y = F.floor(r * F.cos(angle) + (cx + 0.5)).cast("int"), F.floor(r * F.sin(angle) + (cy + 0.5)).cast("int")
        # get() of a negative place, and of one behind the end, is null.
        return F.coalesce(F.get(F.get("m", y), x), F.lit(0.0))

    circle = lambda r: F.transform(F.sequence(F.lit(0), F.lit(angles - 1)), lambda t: value(r, t))
    radii = F.sequence(F.lit(0), F.lit(max_radius - 1)) if max_radius > 0 else F.array().cast("array<int>")
    rows = held.select("image_id", F.explode_outer(F.transform(radii, lambda r: F.struct(r.alias("r"), circle(r).alias("a")))).alias("z"))
    return rows.select("image_id", "z.r", "z.a").where("r is not null")


def angular_median(polar_rows: DataFrame, size: int = 5, angles: int = 360) -> DataFrame:
    """polar rows with the median over `size` (odd) neighbouring angles; the ends are mirrored, the end angle twice."""
    half = size // 2
    at = lambda t: F.get("a", F.when(t < 0, -t - 1).when(t >= angles, 2 * angles - 1 - t).otherwise(t))
    around = lambda t: F.array(*[at(t + d) for d in range(-half, half + 1)])
    return polar_rows.withColumn("a", F.transform(F.sequence(F.lit(0), F.lit(angles - 1)), lambda t: F.get(F.sort_array(around(t)), F.lit(half))))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)


def angular_mean(polar_rows: DataFrame) -> DataFrame:
    """(image_id, r, v)."""
    return polar_rows.select("image_id", "r", _mean(F.col("a")).alias("v"))


def sector_profiles(polar_rows: DataFrame, sectors: int = 8, angles: int = 360) -> DataFrame:
    """(image_id, sector, r, v): means within sectors of whole angles, the last one taking the remainder."""
    width = angles // sectors
    part = lambda k: F.slice("a", k * width + 1, F.when(k < sectors - 1, F.lit(width)).otherwise(angles - width * (sectors - 1)))
    means = F.transform(F.sequence(F.lit(0), F.lit(sectors - 1)), lambda k: _mean(part(k)))
    return polar_rows.select("image_id", "r", F.posexplode(means).alias("sector", "v")).select("image_id", "sector", "r", "v")


def sector_of(x: Column, y: Column, cx: float, cy: float, n: Column | int) -> Column:
    """Slice number from 0, clockwise from 12 o'clock; each pixel is in one slice."""
    n = F.lit(n) if isinstance(n, int) else n
    turned = F.pmod(F.degrees(F.atan2(y - cy, x - cx)) + 90, F.lit(360.0))
    return F.least(F.floor(turned / (F.lit(360.0) / n)).cast("int"), n - 1)


def slice_boxes(px: DataFrame, cx: float, cy: float, n: int) -> DataFrame:
    """(image_id, sector, n_pixels, x0, x1, y0, y1): pixels and bounding box of each slice of pixels (image_id, y, x)."""
    box = [F.count("*").alias("n_pixels"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")]
    return px.groupBy("image_id", sector_of(F.col("x"), F.col("y"), cx, cy, n).alias("sector")).agg(*box)


def manifest(images: DataFrame, low: int = 3, high: int = 30) -> DataFrame:
    """(image, n_slices, slice_no, key) for every slice of every resolution; each image gives sum(low..high) rows."""
    from xylem.functions.columns import slice_key

    rows = images.select("image", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("n_slices")).withColumn("slice_no", F.explode(F.sequence(F.lit(1), F.col("n_slices"))))
    return rows.withColumn("key", slice_key(F.col("image"), F.col("n_slices"), F.col("slice_no")))


def nearest(points: DataFrame, centroids: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """points with their nearest centroid_id; ties go to the smaller one.

    The K centroids (centroid_id, dims) come to the driver and go out as a literal array: no join and no shuffle.
    """
    rows = sorted(centroids.select("centroid_id", *dims).collect())
    known = F.array(*[F.struct(F.lit(r[0]).alias("k"), *[F.lit(float(v)).alias(d) for d, v in zip(dims, r[1:], strict=True)]) for r in rows])
    distance = lambda c: sum(((F.col(d) - c[d]) * (F.col(d) - c[d]) for d in dims[1:]), (F.col(dims[0]) - c[dims[0]]) * (F.col(dims[0]) - c[dims[0]]))
    return points.withColumn("centroid_id", F.array_min(F.transform(known, lambda c: F.struct(distance(c).alias("d"), c["k"].alias("k"))))["k"])


def lloyd_step(points: DataFrame, centroids: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """New centroids: means of what is nearest to the old ones; one that nothing is nearest to stays."""
    means = nearest(points, centroids, dims).groupBy("centroid_id").agg(*[F.avg(d).alias(f"__{d}") for d in dims])
    return centroids.join(means, "centroid_id", "left").select("centroid_id", *[F.coalesce(f"__{d}", d).alias(d) for d in dims])

