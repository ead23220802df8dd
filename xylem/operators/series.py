"""Ordered series: rows (image_id, r, v), one series per image_id.

Windows are partitioned by the series, which holds one image's samples and so is small; folds that depend on what came
before run over a sorted array of the few survivors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from xylem.functions.columns import finite


def along() -> W:
    return W.partitionBy("image_id").orderBy("r")


def explode_series(df: DataFrame, id_col: str, array_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("image_id"), F.posexplode(array_col).alias("r", "v")).withColumn("v", F.col("v").cast("double"))


def central_difference(series: DataFrame, value: str = "v") -> DataFrame:
    """(next - previous) / 2; a series loses its two ends."""
    d = (F.lead(value).over(along()) - F.lag(value).over(along())) / 2
    return series.withColumn(value, d).where(F.col(value).isNotNull())


def local_maxima(series: DataFrame, least: float | None = None, strict: bool = False) -> DataFrame:
    """Samples above both neighbours and, if given, at `least` or above (strict: above); ends and plateaus never count."""
    prev, after = F.lag("v").over(along()), F.lead("v").over(along())
    on = (F.col("v") > prev) & (F.col("v") > after)
    if least is not None:
        on = on & ((F.col("v") > least) if strict else (F.col("v") >= least))
    return series.withColumn("__peak", on).where("__peak").drop("__peak")


def greedy(positions: Column, distance: int) -> Column:
    """Of an ascending array, the first and then each that is `distance` or more beyond the last one kept."""
    empty = F.array().cast("array<int>")
    return F.aggregate(positions.cast("array<int>"), empty, lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) >= distance), F.concat(kept, F.array(x))).otherwise(kept)) if distance > 0 else positions.cast("array<int>")


def suppress(peaks: DataFrame, distance: int, all_ids: DataFrame | None = None) -> DataFrame:
    """(image_id, radii, ring_count) by greedy suppression; with all_ids (image_id), those without a peak have none."""
    out = peaks.groupBy("image_id").agg(greedy(F.sort_array(F.collect_list("r")), distance).alias("radii"))
    if all_ids is not None:
        out = all_ids.join(out, "image_id", "left").withColumn("radii", F.coalesce("radii", F.array().cast("array<int>")))
    return out.withColumn("ring_count", F.size("radii"))


def second_derivative_rings(series: DataFrame, distance: int = 35) -> DataFrame:
    """Maxima above 0 of the second difference. A peak is reported one sample below where it is centred (kept for parity)."""
    twice = central_difference(central_difference(series))
    peaks = local_maxima(twice, 0.0, strict=True).withColumn("r", F.col("r") - 1)
    return suppress(peaks, distance, series.select("image_id").distinct())


def max_normalised(series: DataFrame) -> DataFrame:
    """Divided by the series' maximum where that is above 0."""
    top = F.max("v").over(W.partitionBy("image_id"))
    return series.withColumn("v", F.when(top > 0, F.col("v") / top).otherwise(F.col("v")))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    import math

    n = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-n, n + 1)]
    return [x / sum(w) for x in w]


def smooth(series: DataFrame, sigma: float) -> DataFrame:
    """Gaussian filter; beyond an end the series is mirrored, the end sample twice."""
    weights = gaussian_weights(sigma)
    half, n = len(weights) // 2, F.size("__a")
    packed = series.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("r", "v"))).alias("__p")).select("image_id", F.col("__p.r").alias("__r"), F.col("__p.v").alias("__a"))

    def at(i: Column) -> Column:
        m = F.pmod(i, 2 * n)
        return F.get("__a", F.when(m < n, m).otherwise(2 * n - 1 - m))

    def value(i: Column) -> Column:
        total = None
        for k, w in enumerate(weights):
            term = at(i + (k - half)) * w
            total = term if total is None else total + term
        return total

    out = packed.select("image_id", F.explode_outer(F.arrays_zip(F.col("__r").alias("r"), F.transform(F.sequence(F.lit(0), n - 1), value).alias("v"))).alias("z"))
    return out.select("image_id", "z.r", "z.v")


def autocorrelation(series: DataFrame, most_lag: int | None = None) -> DataFrame:
    """(image_id, lag, v): sums of products of the centred series at each lag, over that at lag 0 (where it is not 0)."""
    packed = series.groupBy("image_id").agg(F.avg("v").alias("m"), F.sort_array(F.collect_list(F.struct("r", "v"))).alias("p"))
    packed = packed.select("image_id", F.transform("p.v", lambda v: finite(v - F.col("m"))).alias("a"))
    n = F.size("a")
    lags = F.sequence(F.lit(0), n - 1 if most_lag is None else F.least(n - 1, F.lit(most_lag)))

    def product(lag: Column) -> Column:
        pairs = F.zip_with(F.slice("a", F.lit(1), n - lag), F.slice(F.col("a"), lag + 1, n - lag), lambda x, y: x * y)
        return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)

    # The outer form, since the arrays are never empty: the other one filters by their size first, and computes them twice.
    rows = packed.withColumn("c", F.transform(lags, product)).select("image_id", F.get("c", F.lit(0)).alias("c0"), F.posexplode_outer("c").alias("lag", "v"))
    return rows.select("image_id", "lag", F.when(F.col("c0") != 0, F.col("v") / F.col("c0")).otherwise(F.col("v")).alias("v"))


def dft_power(series: DataFrame, low: int = 12, high: int = 30) -> DataFrame:
    """(image_id, k, power) of the centred series for k = low..min(high, n div 2)."""
    of = W.partitionBy("image_id")
    centred = series.select("image_id", "r", (F.col("v") - F.avg("v").over(of)).alias("v"), F.count("*").over(of).alias("n"))
    spread = centred.withColumn("k", F.explode(F.sequence(F.lit(low), F.lit(high)))).where("k <= n div 2")
    angle = F.lit(2 * 3.141592653589793) * F.col("k") * F.col("r") / F.col("n")
    sums = spread.groupBy("image_id", "k").agg(F.sum(F.col("v") * F.cos(angle)).alias("re"), F.sum(F.col("v") * F.sin(angle)).alias("im"))
    return sums.select("image_id", "k", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def period_spacing(series: DataFrame, low: int = 12, high: int = 30) -> DataFrame:
    """(image_id, best_k, spacing): the strongest frequency, the lower on a tie, and the length over it, half to even."""
    power = dft_power(series, low, high).withColumn("power", F.round("power", 6))
    best = power.groupBy("image_id").agg(F.max_by("k", F.struct("power", -F.col("k"))).alias("best_k"))
    n = series.groupBy("image_id").agg(F.count("*").alias("n"))
    return best.join(n, "image_id").select("image_id", "best_k", F.bround(F.col("n") / F.col("best_k"), 0).cast("int").alias("spacing"))


def vote(detections: DataFrame, tolerance: int = 10, least_sectors: int = 4) -> DataFrame:
    """(image_id, ring, radius, votes) of detections (image_id, sector, radius).

    Sorted by radius, a group takes all within `tolerance` of its first; it is a ring if so many different sectors are
    in it, of the median radius, cut to a whole number. The next group starts after it either way.
    """
    sorted_all = F.sort_array(F.collect_list(F.struct("radius", "sector")))
    packed = detections.groupBy("image_id").agg(sorted_all.cast("array<struct<radius:int,sector:int>>").alias("d"))
    start = F.struct(F.lit(None).cast("int").alias("anchor"), F.array().cast("array<int>").alias("anchors"))

    def step(acc: Column, x: Column) -> Column:
        new = acc["anchor"].isNull() | (x["radius"] - acc["anchor"] > tolerance)
        anchor = F.when(new, x["radius"]).otherwise(acc["anchor"])
        return F.struct(anchor.alias("anchor"), F.concat(acc["anchors"], F.array(anchor)).alias("anchors"))

    anchored = packed.select("image_id", F.explode(F.zip_with("d", F.aggregate("d", start, step)["anchors"], lambda d, a: F.struct(a.alias("anchor"), d["radius"].alias("radius"), d["sector"].alias("sector")))).alias("z")).select("image_id", "z.*")
    groups = anchored.groupBy("image_id", "anchor").agg(F.countDistinct("sector").alias("votes"), F.percentile("radius", 0.5).cast("int").alias("radius")).where(F.col("votes") >= least_sectors)
    return groups.select("image_id", F.row_number().over(W.partitionBy("image_id").orderBy("anchor")).alias("ring"), "radius", F.col("votes").cast("int").alias("votes"))
