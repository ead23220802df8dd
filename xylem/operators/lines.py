"""Images as lines: one row (image_id, y, g array<double>) per line of pixels.

A line is the unit that is shuffled; what happens within a line is array code, and what needs the lines above and
below takes them by a window over the image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The kernels' values are fixed.
GAUSS = ((1 / 16, 2 / 16, 1 / 16), (2 / 16, 4 / 16, 2 / 16), (1 / 16, 2 / 16, 1 / 16))
SOBEL_X = ((-1.0, 0.0, 1.0), (-2.0, 0.0, 2.0), (-1.0, 0.0, 1.0))
SOBEL_Y = ((-1.0, -2.0, -1.0), (0.0, 0.0, 0.0), (1.0, 2.0, 1.0))


def pixels(lines: DataFrame, value: str = "g") -> DataFrame:
    """(image_id, y, x, value), one row per pixel."""
    return lines.select("image_id", "y", F.posexplode(value).alias("x", value))


def lines_of(px: DataFrame, value: str = "g") -> DataFrame:
    """The inverse of pixels()."""
    packed = F.sort_array(F.collect_list(F.struct("x", value)))
    return px.groupBy("image_id", "y").agg(F.transform(packed, lambda p: p[value].cast("double")).alias("g"))


def per_image(lines: DataFrame, *aggregates: Column) -> DataFrame:
    """lines with aggregates over the whole image: only one row per image is shuffled, not the lines."""
    return lines.join(lines.groupBy("image_id").agg(*aggregates), "image_id")


def whole_images(lines: DataFrame, kernel) -> DataFrame:
    """Lines of what a numpy kernel makes of each image as one array (height x width of doubles, no line missing)."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("y")
        out = np.asarray(kernel(np.stack(pdf["g"].to_list()))).astype(np.float64)
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "y": np.arange(len(out), dtype=np.int32), "g": list(out)})

    return lines.groupBy("image_id").applyInPandas(run, "image_id long, y int, g array<double>")


def minmax(lines: DataFrame, top: int = 255) -> DataFrame:
    """Each image stretched to 0..top, whole numbers (truncated); a flat image is 0."""
    held = per_image(lines, F.min(F.array_min("g")).alias("__lo"), F.max(F.array_max("g")).alias("__hi"))
    scaled = F.when(F.col("__hi") > F.col("__lo"), F.transform("g", lambda v: F.floor((v - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * top).cast("double")))
    return held.withColumn("g", F.coalesce(scaled, F.transform("g", lambda v: F.lit(0.0)))).drop("__lo", "__hi")


def _taps(rows: tuple[Column, Column, Column], kernel, x: Column, width: Column) -> Column:
    """The weighted sum around column x (1-based) of three lines, the border repeated."""
    at = (F.greatest(x - 1, F.lit(1)), x, F.least(x + 1, width))
    total = None
    for row, weights in zip(rows, kernel, strict=True):
        for k, weight in zip(at, weights, strict=True):
            if weight:
                term = F.get(row, k - 1) * weight
                total = term if total is None else total + term
    return total


def convolve(lines: DataFrame, kernel, out: str = "g") -> DataFrame:
    """3 x 3 correlation, edges repeated. One window over the lines of an image."""
    w = W.partitionBy("image_id").orderBy("y")
    rows = lines.withColumns({"__up": F.coalesce(F.lag("g").over(w), F.col("g")), "__down": F.coalesce(F.lead("g").over(w), F.col("g"))})
    width = F.size("g")
    value = F.transform(F.sequence(F.lit(1), width), lambda x: _taps((F.col("__up"), F.col("g"), F.col("__down")), kernel, x, width))
    return rows.withColumn(out, value).drop("__up", "__down")


def sobel(lines: DataFrame, smooth: bool = True) -> DataFrame:
    """Edge strength sqrt(gx^2 + gy^2), after a 3 x 3 Gaussian if smooth."""
    source = convolve(lines, GAUSS) if smooth else lines
    both = convolve(convolve(source, SOBEL_X, "__gx"), SOBEL_Y, "__gy")
    return both.withColumn("g", F.zip_with("__gx", "__gy", lambda a, b: F.sqrt(a * a + b * b))).drop("__gx", "__gy")


def histogram(lines: DataFrame) -> DataFrame:
    """(image_id, v, n, cdf): counts of each value, and running counts."""
    counts = lines.select("image_id", F.explode("g").alias("v")).groupBy("image_id", F.col("v").cast("int").alias("v")).agg(F.count("*").alias("n"))
    return counts.withColumn("cdf", F.sum("n").over(W.partitionBy("image_id").orderBy("v")))


def equalise(lines: DataFrame) -> DataFrame:
    """Histogram equalisation over 256 values: round half up of (cdf - least) / (pixels - least) * 255."""
    h = histogram(lines)
    of = W.partitionBy("image_id")
    least, total = F.min("cdf").over(of), F.max("cdf").over(of)
    level = F.when(total > least, F.floor((F.col("cdf") - least) / (total - least) * 255 + 0.5)).otherwise(F.col("v")).cast("double")
    table = h.select("image_id", "v", level.alias("to")).groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("v", "to"))).alias("m"))
    # A map is searched from its first entry, an array is not: so one array for each image.
    table = table.select("image_id", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: F.try_element_at("m", v)).alias("__to"))
    return lines.join(table, "image_id").withColumn("g", F.transform("g", lambda v: F.get("__to", v.cast("int")))).drop("__to")


def unsharp(lines: DataFrame, amount: float = 1.5) -> DataFrame:
    """(1 + amount) * g - amount * blur, blur by the 3 x 3 Gaussian, rounded half up and held within a byte."""
    blurred = convolve(lines, GAUSS, "__blur")
    sharp = F.zip_with("g", "__blur", lambda g, b: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(g * (1 + amount) - b * amount + 0.5))))
    return blurred.withColumn("g", sharp).drop("__blur")


def moments(lines: DataFrame, above: float = -1.0) -> DataFrame:
    """(image_id, cx, cy): centre of mass of the values above a limit."""
    px = pixels(lines).where(F.col("g") > above)
    return px.groupBy("image_id").agg((F.sum(F.col("x") * F.col("g")) / F.sum("g")).alias("cx"), (F.sum(F.col("y") * F.col("g")) / F.sum("g")).alias("cy"))


def coverage(lines: DataFrame, above: float) -> DataFrame:
    """(image_id, coverage): share of the pixels above a limit; lines are counted before anything is shuffled."""
    counted = lines.select("image_id", F.size(F.filter("g", lambda v: v > above)).alias("on"), F.size("g").alias("n"))
    return counted.groupBy("image_id").agg((F.sum("on") / F.sum("n")).alias("coverage"))


def percentile_radius(lines: DataFrame, cx: float, cy: float, above: float, share: float = 0.87) -> DataFrame:
    """(image_id, r_valid): the share-quantile of the mask's distances from the centre, linearly interpolated."""
    px = pixels(lines).where(F.col("g") > above)
    r = F.sqrt((F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy))
    return px.groupBy("image_id").agg(F.percentile(r, share).alias("r_valid"))


def subsample(lines: DataFrame, above: float, most: int) -> DataFrame:
    """Every step-th pixel of the mask in row order, step = n div most (1 at least)."""
    px = pixels(lines).where(F.col("g") > above)
    place = F.row_number().over(W.partitionBy("image_id").orderBy("y", "x"))
    n = F.count("*").over(W.partitionBy("image_id"))
    px = px.withColumn("__place", place).withColumn("__step", F.greatest(F.lit(1), F.floor(n / most)))
    return px.where((F.col("__place") - 1) % F.col("__step") == 0).drop("__place", "__step")


def patches(lines: DataFrame, size: int) -> DataFrame:
    """(image_id, patch_y, patch_x, n, total): pixels and sum of each size x size patch; edge patches are smaller."""
    px = pixels(lines)
    return px.groupBy("image_id", F.floor(F.col("y") / size).cast("int").alias("patch_y"), F.floor(F.col("x") / size).cast("int").alias("patch_x")).agg(F.count("*").alias("n"), F.sum("g").alias("total"))
