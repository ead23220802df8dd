"""Clusters of points, as relational steps and by MLlib."""

from __future__ import annotations

from pyspark.sql import DataFrame

from xylem.operators.radial import lloyd_step


def lloyd(points: DataFrame, centroids: DataFrame, dims: tuple[str, ...], rounds: int = 20, rtol: float = 1e-4) -> DataFrame:
    """Centroids after so many steps, or when they stand still. Only the centroids, K rows, come to the driver."""
    spark, schema = points.sparkSession, centroids.schema
    now = sorted(centroids.select("centroid_id", *dims).collect())
    for _ in range(rounds):
        held = spark.createDataFrame(now, "centroid_id int, " + ", ".join(f"{d} double" for d in dims))
        after = sorted(lloyd_step(points, held, dims).collect())
        still = all(abs(a - b) <= 1e-8 + rtol * abs(b) for x, y in zip(now, after, strict=True) for a, b in zip(x[1:], y[1:], strict=True))
        now = after
        if still:
            break
    return spark.createDataFrame(now, "centroid_id int, " + ", ".join(f"{d} double" for d in dims)) if now else spark.createDataFrame([], schema)


def mllib_kmeans(points: DataFrame, dims: tuple[str, ...], k: int, seed: int = 42, rounds: int = 200) -> DataFrame:
    """points with `cluster`, by MLlib: the form for many images at once (its start differs, so its clusters may)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=list(dims), outputCol="__f").transform(points)
    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="__f", predictionCol="cluster").fit(data)
    return model.transform(data).drop("__f")
