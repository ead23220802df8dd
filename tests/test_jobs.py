"""Sources, sinks and the job stream."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from xylem.config import KafkaConfig, StoreConfig, kafka_package
from xylem.functions import image as I  # noqa: N812
from xylem.operators import annotations
from xylem.operators import vision as V  # noqa: N812
from xylem.operators.jobs import parse_messages, with_coordinates
from xylem.plans import pipeline
from xylem.session import get_session
from xylem.sinks import objects
from xylem.sources import images
from xylem.streaming import jobs as stream


@pytest.fixture
def pictures(tmp_path):
    y, x = np.mgrid[:120, :120]
    disc = I.colour(np.where(np.hypot(x - 60, y - 60) < 35, 40, 210).astype(np.uint8))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/b.png").write_bytes(I.encode_png(disc))
    (tmp_path / "in/A.PNG").write_bytes(I.encode_png(disc[:50]))
    (tmp_path / "in/broken.png").write_bytes(b"no picture")
    (tmp_path / "in/notes.txt").write_text("x")
    return tmp_path / "in", disc


MESSAGES = [
    {"jobId": "ok", "file": "b.png", "clientId": "c", "metadata": {"coordinatesX": 60, "coordinatesY": 60.5}},
    {"jobId": "none", "file": "b.png"},
    {"jobId": "half", "file": "b.png", "metadata": {"coordinatesX": 3, "coordinatesY": None}},
    {"jobId": "wrong", "file": "b.png", "metadata": {"coordinatesX": "bad", "coordinatesY": 2}},
    {"jobId": "lost", "file": "missing.png"},
]


def test_messages(spark):
    text = [json.dumps(m) for m in MESSAGES] + ["garbage", "", None]
    got = with_coordinates(parse_messages(spark.createDataFrame([(t,) for t in text], "value string"))).collect()
    by = {r.jobId: r for r in got if r.jobId}
    assert len(got) == 8 and (by["ok"].x, by["ok"].y) == (60.0, 60.5) and (by["none"].x, by["none"].y) == (0.0, 0.0) and (by["half"].x, by["half"].y) == (3.0, 0.0) and by["wrong"].x == 0.0
    assert [r.corrupt for r in got if r.jobId is None] == ["garbage", "", None] and all(r.corrupt is None for r in by.values())


def test_stream_of_jobs(spark, pictures, tmp_path):
    folder, _ = pictures
    (tmp_path / "messages").mkdir()
    write = lambda name, rows: (tmp_path / "messages" / name).write_text("\n".join(rows))
    write("1.txt", [json.dumps(m | {"file": f"{folder.as_uri()}/{m['file']}"}) for m in MESSAGES] + ["garbage"])

    class Fails:
        def process(self, image, centre, job=""):
            raise RuntimeError("no luck")

    store = objects.LocalStore(str(tmp_path / "store"))
    run = lambda parsed: pipeline.run_jobs(parsed, lambda: [V.SobelRingDetection(), V.CNNSegmentation(patch=64), Fails()], store=store, now=lambda: "now")

    def once():
        source = spark.readStream.text(str(tmp_path / "messages"))
        stream.await_and_stop(stream.start(stream.results(source, run, 3), "json", str(tmp_path / "checkpoint"), available_now=True, path=str(tmp_path / "out")))
        return [json.loads(r.value) for r in spark.read.json(str(tmp_path / "out")).collect()]

    out = {m["jobId"]: m for m in once()}
    assert {k: m["status"] for k, m in out.items()} == {"ok": "COMPLETED", "none": "COMPLETED", "half": "COMPLETED", "wrong": "COMPLETED", "lost": "FAILED", None: "FAILED"}
    results = out["ok"]["data"]["results"]
    assert set(results) == {"sobel_ring_detection", "c_n_n_segmentation", "fails"} and results["fails"] == {"error": "no luck", "status": "failed"}
    assert out["ok"]["data"]["metadata"] == {"coordinatesX": 60.0, "coordinatesY": 60.5} and out["ok"]["error"] is None and out["ok"]["timestamp"] == "now"
    assert results["sobel_ring_detection"]["ring_count"] == 1 and abs(results["sobel_ring_detection"]["radii"][0] - 35) <= 2
    assert out["lost"]["error"] == "Failed to download image" and "garbage" in out[None]["error"] and out["lost"]["data"] is None
    assert (tmp_path / "store/app/results/ok_sobel_ring_detection.png").exists() and (tmp_path / "store/app/results/ok_c_n_n_segmentation_mask.png").exists()
    write("2.txt", [json.dumps({"jobId": "later", "file": "nowhere"})])
    assert sorted(str(m["jobId"]) for m in once()) == sorted(["ok", "none", "half", "wrong", "lost", "None", "later"])


def test_failed_upload_keeps_the_job():
    def broken(key, data):
        raise OSError("full")

    assert pipeline.put_image(np.zeros((2, 2, 3), np.uint8), "j", "k", "", broken, "d") == ("https://d/placeholder/app/results/j_k.png", False)


def test_batch_function_and_one_result_a_job(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("a", 1), (None, 2), (None, 3)], "jobId string, v int").write.parquet(str(tmp_path / "in"))
    seen = []
    source = spark.readStream.schema("jobId string, v int").parquet(str(tmp_path / "in"))
    stream.await_and_stop(stream.start(source, lambda batch, k: seen.append(stream.once_per_job(batch).count()), str(tmp_path / "c"), available_now=True))
    assert seen == [3]


def test_scans(spark, pictures):
    folder, disc = pictures
    rows = {r.image: r for r in images.scan_images(spark, str(folder)).collect()}
    assert set(rows) == {"A", "b", "broken"} and not rows["broken"].ok and rows["broken"].height == -1
    assert (images.as_array(rows["b"].height, rows["b"].width, rows["b"].channels, bytes(rows["b"].data)) == disc).all()
    listed = images.list_files(spark, str(folder), "png")
    assert [r.name for r in listed.collect()] == ["A.PNG", "b.png", "broken.png"] and images.list_files(spark, str(folder), "png", 2).count() == 2
    assert "ReadSchema: struct<path:string,length:bigint>" in listed._jdf.queryExecution().executedPlan().toString()
    assert images.stream_images(spark, str(folder)).isStreaming


def test_side_tables(spark, tmp_path):
    for name, text in (("pith.csv", "Image,cx,cy\nF10b,500,400\n"), ("rings.csv", "image_code,rings_count\nF10b,23\n"), ("c.csv", "codigo_imagen,x,y\nF02a,512,384\n")):
        (tmp_path / name).write_text(text)
    pith = images.read_pith(spark, str(tmp_path / "pith.csv")).first()
    assert (pith.image, pith.x, pith.y) == ("F10b", 400.0, 500.0) and images.read_pith(spark, str(tmp_path / "pith.csv"), False).first().x == 500.0
    assert images.read_ring_counts(spark, str(tmp_path / "rings.csv")).first().rings_count == 23
    assert V.read_centres([r.asDict() | {"codigo_imagen": r.image} for r in images.read_centres(spark, str(tmp_path / "c.csv")).collect()]) == {"F02a": (512, 384)}
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes/F10b.json").write_text(json.dumps({"shapes": [{"points": [[1.9, 2], [4, 6]]}, {"points": []}, {}]}))
    (tmp_path / "notes/bad.json").write_text("{")
    rows = images.read_annotations(spark, str(tmp_path / "notes"))
    points = annotations.explode_points(rows)
    assert [(r.image_id, r.shape, r.point, r.x, r.y) for r in points.orderBy("point").collect()] == [("F10b", 0, 0, 1, 2), ("F10b", 0, 1, 4, 6)]
    status = {r.image_id: r.status for r in annotations.annotation_status(rows.select("image_id"), points).collect()}
    assert status == {"F10b": "SUCCESS", "bad": "WARNING: no rings"}
    null = F.lit(None).cast("double")
    x, y = images.resolve_centre(null, null, F.lit(7.0), null, F.lit(1.0), F.lit(2.0))
    assert tuple(spark.range(1).select(x, y).first()) == (7.0, 2.0)


def test_uploads(spark, pictures, tmp_path):
    folder, _ = pictures
    done = objects.upload_folder(spark, str(folder), "images/", objects.LocalStore(str(tmp_path / "s")))
    assert done.where("ok").count() == 4 and (tmp_path / "s/images/b.png").exists()
    (folder / "more").mkdir()
    (folder / "more/b.png").write_bytes(b"another")
    again = objects.upload_folder(spark, str(folder), "deep", objects.UriStore((tmp_path / "u").as_uri()), "png").collect()
    assert {r.key for r in again} == {"deep/b.png", "deep/broken.png", "deep/more/b.png"} and all(r.ok for r in again)
    assert (tmp_path / "u/deep/more/b.png").read_bytes() == b"another" and not list((tmp_path / "u").rglob("*.tmp"))
    (folder / "more/b.png").unlink()
    assert objects.upload_manifest(done, "objects.invalid", "lists/all", objects.UriStore((tmp_path / "u").as_uri())).where("ok").count() >= 1
    urls = [json.loads(x) for f in (tmp_path / "u/lists").iterdir() for x in f.read_text().splitlines()]
    assert {"filename": "b.png", "url": "https://objects.invalid/images/b.png"} in urls and len(urls) == 4
    listed = objects.manifest(done, "objects.invalid")
    objects.write_csv(listed, str(tmp_path / "manifest"))
    read = spark.read.csv(str(tmp_path / "manifest"), header=True)
    assert read.where("filename = 'b.png'").first().url == "https://objects.invalid/images/b.png"
    (tmp_path / "one.csv").write_text("image_code,rings_count\n")
    assert objects.copy_file(spark, str(tmp_path / "one.csv"), "metadata/ring_counts.csv", objects.LocalStore(str(tmp_path / "s"))).first().ok
    bad = objects.upload_folder(spark, str(folder), "x", objects.LocalStore("/proc/none"), "txt").collect()
    assert len(bad) == 1 and not bad[0].ok and bad[0].error
    fetched = images.fetch_bytes(spark.createDataFrame([((folder / "b.png").as_uri(),), ("file:///none",)], "url string")).collect()
    assert [r.content is None for r in fetched] == [False, True] and fetched[1].error
    with pytest.raises(ValueError, match="confirm"):
        objects.purge(spark, str(tmp_path / "s"))
    assert objects.purge(spark, str(tmp_path / "s"), confirm=True) == 5 and not (tmp_path / "s").exists()


def test_configuration(monkeypatch, spark):
    assert KafkaConfig().read_options()["subscribe"] == "image-ingestion" and KafkaConfig().write_options()["topic"] == "processing-results"
    monkeypatch.setenv("KAFKA_TOPIC_INGESTION", "other")
    assert KafkaConfig().ingestion_topic == "other" and kafka_package("4.1.2").endswith("_2.13:4.1.2")
    assert StoreConfig("s3a://b", "https://{bucket}.{domain}/{key}", "d").url("k", "b") == "https://b.d/k"
    assert get_session("again").sparkContext is spark.sparkContext
    with pytest.raises(Exception, match="kafka"):
        stream.message_stream(spark, KafkaConfig())


def test_small_surfaces(spark):
    from xylem.operators import clusters, udfs
    from xylem.operators.jobs import expected_slices

    assert expected_slices(64) == {"files": 29_568, "label_bytes": 2_956_800}
    udfs.register(spark)
    assert spark.sql("select count(*), max(n_slices) from slices(3, 30)").first() == (462, 30)
    jobs = spark.createDataFrame([("j", "u", "c", 1.0, 2.0)], "jobId string, file string, clientId string, x double, y double")
    assert json.loads(udfs.mock_results(jobs, "t").first().value) == V.mock_result("j", "u", "c", 1.0, 2.0, "t")
    rng = np.random.default_rng(1)
    points = [(i, float(c[0] + rng.normal()), float(c[1] + rng.normal())) for i, c in enumerate([(0, 0), (50, 0), (0, 50)] * 40)]
    df = spark.createDataFrame(points, "point_id long, a double, b double")
    start = spark.createDataFrame([(0, 1.0, 1.0), (1, 20.0, 1.0), (2, 1.0, 20.0), (3, 9e9, 9e9)], "centroid_id int, a double, b double")
    got = {r.centroid_id: (r.a, r.b) for r in clusters.lloyd(df, start, ("a", "b")).collect()}
    for k, c in enumerate([(0, 0), (50, 0), (0, 50)]):
        assert np.allclose(got[k], c, atol=1)
    assert got[3] == (9e9, 9e9)
    assert clusters.mllib_kmeans(df, ("a", "b"), 3).groupBy("cluster").count().where("count = 40").count() == 3


def test_scaling_task(spark):
    from xylem.operators.udfs import slow_task

    assert slow_task(spark.range(0, 1000, 1, 100), 0.0).agg(F.count("*"), F.sum("doubled")).first() == (1000, 999_000)


def test_program_runs_a_folder_of_messages(spark, pictures, tmp_path):
    """value in, value out: a folder of messages stands for the topic, and results come as the same JSON lines."""
    from xylem.__main__ import arguments, main

    folder, _ = pictures
    (tmp_path / "messages").mkdir()
    (tmp_path / "messages/1.txt").write_text("\n".join([json.dumps(m | {"file": f"{folder.as_uri()}/{m['file']}"}) for m in MESSAGES] + ["garbage"]))
    main(["--messages", str(tmp_path / "messages"), "--out", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "checkpoint"), "--store", (tmp_path / "s").as_uri(), "--once"])
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    status = {r["jobId"]: r["status"] for r in got}
    assert len(got) == 6 and status["ok"] == "COMPLETED" and status["lost"] == status[None] == "FAILED"
    assert list((tmp_path / "s/app/results").glob("ok_*.png"))
    with pytest.raises(SystemExit):
        arguments([])


def test_jpeg_files_are_scanned(spark, tmp_path):
    image = spark._jvm.java.awt.image.BufferedImage(40, 30, 5)
    for name in ("a.jpg", "b.JPEG"):
        assert spark._jvm.javax.imageio.ImageIO.write(image, "jpg", spark._jvm.java.io.File(str(tmp_path / name)))
    rows = images.scan_images(spark, str(tmp_path)).collect()
    assert sorted((r.image, r.height, r.width, r.ok) for r in rows) == [("a", 30, 40, True), ("b", 30, 40, True)]
