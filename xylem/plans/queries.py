"""One query per operator of the engine, over the driver's tables."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from xylem.functions import columns as C
from xylem.operators import annotations, jobs, radial
from xylem.operators import lines as L
from xylem.operators import series as S
from xylem.plans.adapters import canvas, messages, profile, sidecar, table

#: Centre of the canvas between pixels, and on one.
HALF, CENTRE = (31.5, 24.5), (32.0, 25.0)
ALGORITHMS = ("RingDetection", "UnsharpMasking", "PolarRingDetection", "SobelRingDetection", "AutocorrelationPeriodicity", "SecondDerivativeRingDetection", "KMeansRingCounter", "CNNSegmentation")
CENTROIDS = ((0, 10.0, 2.0), (1, 50.0, 8.0), (2, 100.0, 14.0), (3, 200.0, 20.0), (4, 1e6, 1e6))
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """9 places where a share of a count may end in a 5 at the seventh, which engines round either way."""
    return df.withColumns({n: F.round(n, places) for n in names})


@query
def json_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("p")).select("event_id", "p.k")


@query
def message_flatten_defaults(spark: SparkSession, d: str) -> DataFrame:
    return jobs.with_coordinates(jobs.parse_messages(messages(spark, d))).select("jobId", "file", "clientId", "x", "y")


@query
def extension_filter_stem(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "pages").select("page_id", C.base_name(F.col("url")).alias("name"))
    return names.where(C.has_extension(F.col("name"), ".html")).orderBy("name", "page_id").limit(50).select("page_id", C.stem(F.col("name")).alias("stem"))


@query
def key_template(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    key = C.slice_key(F.col("source"), F.col("doc_id") % 28 + 3, F.col("doc_id") % 7)
    return docs.select("doc_id", key.alias("key"), C.public_url("objects.invalid", C.result_key(F.col("source"), F.col("lang"))).alias("url"))


@query
def snake_case_key(spark: SparkSession, d: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, ALGORITHMS)), (F.col("doc_id") % len(ALGORITHMS)).cast("int"))
    return table(spark, d, "documents").select("doc_id", name.alias("name")).withColumn("algo_key", C.snake_case(F.col("name")))


@query
def lookup_with_status(spark: SparkSession, d: str) -> DataFrame:
    images, labels = sidecar(spark, d)
    return jobs.lookup(images, labels, "doc_id", "SUCCESS", "ERROR: no label").select("doc_id", "quality", "status")


@query
def lookup_chain_two(spark: SparkSession, d: str) -> DataFrame:
    orders, customer, nation = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return orders.join(customer, orders.o_custkey == customer.c_custkey, "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


@query
def status_summary(spark: SparkSession, d: str) -> DataFrame:
    images, labels = sidecar(spark, d)
    joined = images.join(labels.withColumn("hit", F.lit(True)), "doc_id", "left")
    message = F.when(F.col("hit").isNull(), "ERROR: missing").when(F.col("quality") == 0, "WARNING: low").otherwise("SUCCESS: done")
    return jobs.classify(joined.select(message.alias("message"))).groupBy("status").agg(F.count("*").alias("n"))


@query
def message_number_extract_sum(spark: SparkSession, d: str) -> DataFrame:
    message = F.concat(F.lit("SUCCESS - Total size: "), F.format_string("%.2f", "value"), F.lit(" MB"))
    rows = table(spark, d, "events").select("event_type", C.megabytes_of(message).alias("mb"))
    return rows.groupBy("event_type").agg(F.count("mb").alias("n"), F.round(F.sum("mb"), 6).alias("mb"))


@query
def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    few = labels.groupBy("quality", "toxic").agg(F.count("*").alias("n"))  # a row per label: the window below is over these
    distinct = F.size(F.collect_set("quality").over(W.partitionBy(F.lit(1)))).cast("long")
    return few.withColumn("n_distinct", distinct).orderBy("quality", "toxic").limit(10)


@query
def slice_manifest(spark: SparkSession, d: str) -> DataFrame:
    return radial.manifest(table(spark, d, "nation").select(F.col("n_name").alias("image")))


@query
def slice_reconcile(spark: SparkSession, d: str) -> DataFrame:
    expected = radial.manifest(table(spark, d, "nation").select(F.col("n_name").alias("image")))
    return jobs.reconcile(expected, expected.where("not (image like 'N%' and slice_no = 30)"), "image")


@query
def status_first_last(spark: SparkSession, d: str) -> DataFrame:
    return jobs.first_and_last(table(spark, d, "documents").select("doc_id"), "doc_id")


@query
def sector_pixels(spark: SparkSession, d: str) -> DataFrame:
    px = L.pixels(canvas(spark, d))
    sector = radial.sector_of(F.col("x"), F.col("y"), *HALF, 16).alias("sector")
    return px.groupBy("image_id", sector).agg(F.count("*").alias("n"), F.sum("g").cast("long").alias("total"))


@query
def sector_bbox(spark: SparkSession, d: str) -> DataFrame:
    return radial.slice_boxes(L.pixels(canvas(spark, d)), *HALF, 16)


@query
def space_saved(spark: SparkSession, d: str) -> DataFrame:
    lines = canvas(spark, d)
    boxes = radial.slice_boxes(L.pixels(lines), *HALF, 16)
    whole = lines.groupBy("image_id").agg(F.sum(F.size("g")).alias("n"))
    kept = boxes.groupBy("image_id").agg(F.count("*").alias("slices"), F.sum((F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)).alias("kept"))
    return kept.join(whole, "image_id").select("image_id", "slices", F.round(C.space_saved(F.col("slices") * F.col("n"), F.col("kept")), 9).alias("saved"))


@query
def listing_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.col("source").alias("prefix")).agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"))


@query
def subsample_stride(spark: SparkSession, d: str) -> DataFrame:
    return L.subsample(canvas(spark, d), 127, 500)


@query
def minmax_normalise(spark: SparkSession, d: str) -> DataFrame:
    return L.pixels(canvas(spark, d))


@query
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return L.histogram(canvas(spark, d))


@query
def histogram_equalise(spark: SparkSession, d: str) -> DataFrame:
    return L.pixels(L.equalise(canvas(spark, d)))


@query
def conv3x3_sobel(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.pixels(L.sobel(canvas(spark, d))), "g")


@query
def ray_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(radial.ray_profile(canvas(spark, d), *CENTRE, range(0, 22)), "v")


@query
def polar_sector_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(radial.sector_profiles(radial.polar(canvas(spark, d), *CENTRE, 30)), "v")


@query
def angular_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(radial.angular_mean(radial.polar(canvas(spark, d), *CENTRE, 30)), "v")


@query
def angular_median(spark: SparkSession, d: str) -> DataFrame:
    return radial.angular_median(radial.polar(canvas(spark, d), *CENTRE, 30)).select("image_id", "r", F.posexplode("a").alias("t", "v"))


@query
def central_difference(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.central_difference(profile(spark, d)), "v")


@query
def local_maxima(spark: SparkSession, d: str) -> DataFrame:
    return S.local_maxima(profile(spark, d))


@query
def greedy_suppression(spark: SparkSession, d: str) -> DataFrame:
    return S.suppress(S.local_maxima(profile(spark, d)), 5)


@query
def second_derivative_rings(spark: SparkSession, d: str) -> DataFrame:
    return S.second_derivative_rings(profile(spark, d), 5)


@query
def sobel_rings(spark: SparkSession, d: str) -> DataFrame:
    along = S.max_normalised(radial.ray_profile(L.sobel(canvas(spark, d)), *CENTRE, range(3, 24)))
    along = along.withColumn("v", F.round("v", 9))
    return S.suppress(S.local_maxima(along, 0.5), 4, along.select("image_id").distinct())


@query
def gaussian_smooth(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.smooth(profile(spark, d), 2.5), "v")


@query
def vote_consolidate(spark: SparkSession, d: str) -> DataFrame:
    peaks = S.local_maxima(profile(spark, d))
    return S.vote(peaks.select(F.expr("image_id div 10").alias("image_id"), (F.col("image_id") % 10).alias("sector"), F.col("r").alias("radius")), 2, 4)


@query
def autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.autocorrelation(profile(spark, d)), "v")


@query
def dft_power(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.dft_power(profile(spark, d)), "power")


@query
def period_spacing(spark: SparkSession, d: str) -> DataFrame:
    return S.period_spacing(profile(spark, d))


@query
def percentile_radius(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.percentile_radius(canvas(spark, d), *HALF, 127), "r_valid")


@query
def moments_centre(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.moments(canvas(spark, d), 127), "cx", "cy", places=9)


def _points(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    points = table(spark, d, "events").select(F.col("event_id").alias("point_id"), F.col("value").alias("v"), F.hour("ts").cast("double").alias("h"))
    return points, spark.createDataFrame(list(CENTROIDS), "centroid_id int, v double, h double")


@query
def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    return radial.nearest(*_points(spark, d), ("v", "h")).select("point_id", "centroid_id")


@query
def lloyd_step(spark: SparkSession, d: str) -> DataFrame:
    return rounded(radial.lloyd_step(*_points(spark, d), ("v", "h")), "v", "h", places=9)


@query
def mask_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.coverage(canvas(spark, d), 127), "coverage", places=9)


@query
def patch_grid(spark: SparkSession, d: str) -> DataFrame:
    return L.patches(canvas(spark, d), 20)


@query
def unsharp_mask(spark: SparkSession, d: str) -> DataFrame:
    return L.pixels(L.unsharp(canvas(spark, d)))


@query
def annotation_explode(spark: SparkSession, d: str) -> DataFrame:
    at = lambda s, p, k: F.element_at("embedding", (s * 8 + p * 2 + k).cast("int")).cast("double") * 100
    points = lambda s: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda p: F.array(at(s, p, 1), at(s, p, 2)))
    shapes = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda s: F.struct(points(s).alias("points")))
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), shapes.alias("shapes"))
    return rounded(annotations.shape_summary(annotations.explode_points(rows)), "perimeter")


@query
def pipeline_envelope(spark: SparkSession, d: str) -> DataFrame:
    parsed = jobs.with_coordinates(jobs.parse_messages(messages(spark, d)))
    error = F.when(F.col("o_orderkey") % 17 == 0, "Failed to download image")
    result = jobs.envelope(F.col("jobId"), F.col("clientId"), F.col("file"), F.col("x"), F.col("y"), F.create_map(F.lit("ring_detection"), F.lit("ok")), error, F.lit(None).cast("string"))
    sent = parsed.select(jobs.to_message(result).alias("value"))
    read = F.from_json("value", "jobId string, clientId string, status string, data struct<originalUrl: string, metadata: struct<coordinatesX: double, coordinatesY: double>>, error string")
    return sent.select(read.alias("m")).select("m.jobId", "m.clientId", "m.status", F.col("m.data.originalUrl").alias("url"), F.col("m.data.metadata.coordinatesX").alias("x"), "m.error")


def _shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode, where it may be unset, one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = root or tempfile.mkdtemp()
    return root.rstrip("/") if "://" in root else f"file://{root.removeprefix('file:').rstrip('/')}"


@query
def stream_parse_available_now(spark: SparkSession, d: str) -> DataFrame:
    """The events as a file stream, parsed and written once through; then read as a table."""
    from xylem.streaming.jobs import run_once

    root = _shared(spark)
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")
    parsed = stream.select("event_id", F.from_json("props", "k int").alias("p")).select("event_id", "p.k")
    return run_once(parsed, root)


@query
def url_manifest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(C.base_name(F.col("url")).alias("filename"), C.public_url("objects.invalid", F.concat(F.lit("pages/"), F.col("page_id"), F.lit(".json"))).alias("url"))


@query
def slow_task_count(spark: SparkSession, d: str) -> DataFrame:
    """The scaling test: a thousand numbers in a hundred partitions, each doubled by a Python task (its delay set to 0 here)."""
    from xylem.operators.udfs import slow_task

    return slow_task(spark.range(0, 1000, 1, 100), seconds=0.0).agg(F.count("*").alias("n"), F.sum("doubled").alias("total"))


def _pictures(spark: SparkSession, d: str) -> DataFrame:
    """The canvas as scanned images, enlarged so that rings have room, with a centre each."""
    lines = canvas(spark, d)
    wide = lines.select("image_id", F.explode(F.sequence(F.col("y") * 4, F.col("y") * 4 + 3)).alias("y"), F.transform("g", lambda v: F.repeat(F.lpad(F.hex(v.cast("int")), 2, "0"), 3)).alias("h"))
    body = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "h"))), lambda p: F.array_join(p["h"], "")), ""))
    out = wide.groupBy("image_id").agg(body.alias("data"), (F.max("y") + 1).cast("int").alias("height"))
    return out.select(F.concat(F.lit("canvas"), F.col("image_id")).alias("image"), "height", F.lit(64 * 3).alias("width"), F.lit(1).alias("channels"), "data", F.lit(True).alias("ok"), F.lit(96.0).alias("x"), F.lit(100.0).alias("y"))


@query
def image_pipeline(spark: SparkSession, d: str) -> DataFrame:
    from xylem.operators.vision import DEFAULT, KMeansRingCounter
    from xylem.plans.pipeline import run_images

    return run_images(_pictures(spark, d), lambda: [a() for a in DEFAULT if a is not KMeansRingCounter], 16).select("image", "algorithm", "ok", "rings", "radii")


@query
def kmeans_rings(spark: SparkSession, d: str) -> DataFrame:
    from xylem.operators.vision import KMeansRingCounter
    from xylem.plans.pipeline import run_images

    return run_images(_pictures(spark, d), lambda: [KMeansRingCounter()], 16).select("image", "rings", "radii")


@query
def image_slices(spark: SparkSession, d: str) -> DataFrame:
    from xylem.plans.pipeline import slice_images

    return slice_images(_pictures(spark, d)).select("image", "n_slices", "slice_no", "key", "x0", "y0", "w", "h", "status")


@query
def mock_ring_detection(spark: SparkSession, d: str) -> DataFrame:
    """A count and a confidence that hang on the job's name alone."""
    job = F.concat(F.lit("job-"), F.col("o_orderkey"))
    rows = table(spark, d, "orders").select(job.alias("jobId"))
    return rows.select("jobId", (20 + F.floor(C.uniform(F.col("jobId"), "rings") * 16)).cast("int").alias("count"), F.round(0.85 + 0.13 * C.uniform(F.col("jobId"), "confidence"), 3).alias("confidence"))


@query
def image_scan_status(spark: SparkSession, d: str) -> DataFrame:
    """Pictures of the canvas, and one file that is none, written to the shared folder and scanned again."""
    import uuid

    from xylem.functions.image import encode_png
    from xylem.sinks.objects import UriStore, put_all
    from xylem.sources.images import as_array, scan_images

    root = f"{_shared(spark)}/images-{uuid.uuid4().hex}"

    def encoded(batches):
        for pdf in batches:
            png = [encode_png(as_array(r.height, r.width, r.channels, r.data)) for r in pdf.itertuples()]
            yield pdf.assign(key=pdf.image + ".PNG", content=png)[["key", "content"]]

    files = _pictures(spark, d).select("image", "height", "width", "channels", "data").mapInPandas(encoded, "key string, content binary")
    broken = spark.sql("select 'broken.png' as key, cast('no picture' as binary) as content")
    put_all(files.unionAll(broken), UriStore(root)).where("not ok").count()
    return scan_images(spark, root).select("image", "height", "width", "channels", "ok")


def _kernel(spark: SparkSession, d: str, kernel) -> DataFrame:
    return L.pixels(L.whole_images(canvas(spark, d), kernel))


@query
def kernel_erode(spark: SparkSession, d: str) -> DataFrame:
    from xylem.functions import image as I  # noqa: N812

    return _kernel(spark, d, lambda g: I.erode(g > 127, I.ellipse_offsets(3)))


@query
def kernel_dilate(spark: SparkSession, d: str) -> DataFrame:
    from xylem.functions import image as I  # noqa: N812

    return _kernel(spark, d, lambda g: I.dilate(g > 127, 2))


@query
def kernel_blur(spark: SparkSession, d: str) -> DataFrame:
    from xylem.functions import image as I  # noqa: N812

    return _kernel(spark, d, lambda g: I.blur(g.astype("uint8"), 5, 1.0))


@query
def kernel_gradient(spark: SparkSession, d: str) -> DataFrame:
    from xylem.functions import image as I  # noqa: N812

    return rounded(_kernel(spark, d, lambda g: I.gradient(g, "edge")), "g")


@query
def kernel_resize(spark: SparkSession, d: str) -> DataFrame:
    from xylem.functions import image as I  # noqa: N812

    return _kernel(spark, d, lambda g: I.resize(g.astype("uint8"), len(g) // 2, g.shape[1] // 2))


@query
def kernel_luma(spark: SparkSession, d: str) -> DataFrame:
    """Grey of a colour image whose green and red are made from its blue."""
    import numpy as np

    from xylem.functions import image as I  # noqa: N812

    return _kernel(spark, d, lambda g: I.grey(np.stack([g, g * 7 % 256, g * 13 % 256], axis=2).astype("uint8")))


@query
def kernel_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Local maxima of each series that stand out by 0.15 at least."""
    import pandas as pd

    from xylem.functions import image as I  # noqa: N812

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        return pdf.iloc[I.peaks(pdf["v"].to_numpy(), prominence=0.15)][["image_id", "r"]]

    return profile(spark, d).groupBy("image_id").applyInPandas(run, "image_id long, r int")


@query
def side_tables(spark: SparkSession, d: str) -> DataFrame:
    """Pith, ring-count and centre CSV files, written from customers and read again, met by image."""
    import uuid

    from xylem.sinks.objects import write_csv
    from xylem.sources.images import read_centres, read_pith, read_ring_counts

    root, k = f"{_shared(spark)}/side-{uuid.uuid4().hex}", F.col("c_custkey")
    rows, image = table(spark, d, "customer"), F.concat(F.lit("img"), k)
    write_csv(rows.select(image.alias("Image"), (k % 97 + 0.5).alias("cx"), (k % 61 + 0.25).alias("cy")), f"{root}/pith")
    write_csv(rows.where("c_custkey % 5 <> 0").select(image.alias("image_code"), (k % 40).alias("rings_count")), f"{root}/counts")
    write_csv(rows.where("c_custkey % 7 <> 0").select(image.alias("codigo_imagen"), (k % 50).alias("x"), (k % 30).alias("y")), f"{root}/centres")
    centres = read_centres(spark, f"{root}/centres").select("image", F.col("x").alias("centre_x"), F.col("y").alias("centre_y"))
    return read_pith(spark, f"{root}/pith").join(read_ring_counts(spark, f"{root}/counts"), "image", "left").join(centres, "image", "left")


@query
def object_uploads(spark: SparkSession, d: str) -> DataFrame:
    """Nations as objects, uploaded from a folder to another place under the store, listed there."""
    import uuid

    from xylem.sinks.objects import UriStore, put_all, upload_folder

    root = f"{_shared(spark)}/objects-{uuid.uuid4().hex}"
    rows = table(spark, d, "nation")
    made = rows.select(F.concat(F.lit("in/"), F.col("n_regionkey"), F.lit("/"), F.col("n_nationkey"), F.lit(".txt")).alias("key"), F.col("n_name").cast("binary").alias("content"))
    put_all(made, UriStore(root)).where("not ok").count()
    return upload_folder(spark, f"{root}/in", "copies", UriStore(root), "txt").select("key", "bytes", "ok")
