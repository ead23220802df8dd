"""Algorithms on images whose rings are known."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from xylem.functions import image as I  # noqa: N812
from xylem.operators import vision as V  # noqa: N812
from xylem.plans import pipeline


def distance(h, w, cx, cy):
    y, x = np.mgrid[:h, :w]
    return np.hypot(x - cx, y - cy)


def sines(period, size=400, cx=200, cy=200):
    return I.colour((127.5 + 100 * np.cos(2 * np.pi * distance(size, size, cx, cy) / period)).astype(np.uint8))


def dark_rings(radii, size=500, cx=250, cy=250, width=2.5):
    d = distance(size, size, cx, cy)
    return I.colour((220 - 180 * np.max([np.exp(-((d - r) ** 2) / (2 * width**2)) for r in radii], axis=0)).astype(np.uint8))


DISC = I.colour(np.where(distance(400, 400, 200, 200) < 100, 40, 210).astype(np.uint8))
FLAT = np.full((200, 200, 3), 90, np.uint8)
TINY = np.zeros((1, 1, 3), np.uint8)


def test_sobel_finds_the_step():
    got = V.SobelRingDetection().process(DISC, (200.0, 200.0)).payload
    assert got["ring_count"] == 1 and abs(got["radii"][0] - 100) <= 2 and got["metrics"]["max_radius"] == 190


def test_second_derivative_finds_dark_rings():
    got = V.SecondDerivativeRingDetection(distance=5).process(dark_rings([60, 110, 160, 210]), (250, 250)).payload
    assert all(any(abs(r - want) <= 3 for r in got["radii"]) for want in (60, 110, 160, 210))


def test_polar_votes_for_dark_rings():
    wanted = [80, 120, 160, 200]
    image = dark_rings(wanted)
    wedge = I.sector_mask(500, 500, 250, 250, 18, 3)
    image[wedge] = 220
    got = V.PolarRingDetection().process(image, (250, 250)).payload
    near = [r for r in got["radii"] if r < 230]
    assert len(near) == 4 and all(abs(a - b) <= 3 for a, b in zip(near, wanted))
    assert got["metrics"]["confirmed_rings"] == got["ring_count"] and got["metrics"]["average_votes_per_ring"] >= 4


@pytest.mark.parametrize("period", [12, 16])
def test_period_of_sines(period):
    x = np.cos(2 * np.pi * np.arange(240) / period)
    spacing, m = V.AutocorrelationPeriodicity().period(x)
    assert m["autocorr_used"] and abs(spacing - period) <= 1
    got = V.AutocorrelationPeriodicity().process(sines(2 * period), (200, 200)).payload
    assert got["ring_count"] == len(got["radii"]) > 0 and got["radii"] == sorted(got["radii"])


def test_period_by_frequency_where_no_lag_stands_out():
    x = np.random.default_rng(1).random(15)
    spacing, m = V.AutocorrelationPeriodicity(prominence=99.0).period(x)
    assert not m["autocorr_used"] and (spacing is None or m["fft_used"])
    assert V.AutocorrelationPeriodicity().period(np.zeros(100))[0] is None


def test_kmeans_is_drawn_to_what_is_expected():
    got = V.KMeansRingCounter(most_pixels=800, candidates=(25, 28)).process(dark_rings([40, 80, 120, 160, 200]), (250, 250)).payload
    assert got["k_optimo"] in (25, 28) and 0 < got["num_anillos"] <= 28 and got["radios_anillos"] == sorted(got["radios_anillos"])
    assert all(r <= got["radio_max_usado"] for r in got["radios_anillos"])
    again = V.KMeansRingCounter(most_pixels=800, candidates=(25, 28)).process(dark_rings([40, 80, 120, 160, 200]), (250, 250)).payload
    assert got == again


def test_centres_fall_back():
    k, mask = V.KMeansRingCounter(centres={"F02a": (3, 4)}), np.zeros((10, 20), bool)
    assert k.centre((5.9, 6.2), "F02a", mask) == (5, 6) and k.centre(None, "F02a", mask) == (3, 4) and k.centre((None, 1), "x", mask) == (10, 5)
    mask[2:5, 6:9] = True
    assert k.centre(None, "x", mask) == (7, 3)


def test_segmentation_in_patches():
    got = V.CNNSegmentation(patch=64).process(DISC, (0, 0))
    assert got.payload["num_patches"] == 49 and abs(got.payload["mask_coverage"] - np.pi * 100**2 / 400**2) < 0.01
    assert (got.mask > 0)[200, 200] and not got.mask[5, 5] and got.visual[5, 5].tolist() == [147] * 3 and got.visual[200, 200].tolist() == [28, 104, 28]
    strip = np.zeros((10, 9000, 3), np.uint8)
    wide = V.CNNSegmentation(predictor=lambda b: 1 - b.mean(axis=3, keepdims=True)).process(strip, (0, 0))
    assert max(wide.payload["processed_size"]) <= 8000 and wide.mask.shape == (10, 9000) and wide.payload["mask_coverage"] == 1


def test_unsharp_and_mock():
    assert (V.UnsharpMasking().process(FLAT, (0, 0)).visual == FLAT).all()
    got = V.RingDetection().process(DISC, (0, 0), "job-1")
    assert got.payload == V.RingDetection().process(DISC, (0, 0), "job-1").payload and 20 <= got.payload["count"] <= 35 and 0.85 <= got.payload["details"]["confidence"] <= 0.98
    assert {20, 35} <= {V.RingDetection().process(TINY, (0, 0), f"j{k}").payload["count"] for k in range(300)}
    assert V.mock_result("j", "u", "c", 1.0, 2.0, "t")["data"]["metadata"] == {"coordinatesX": 1.0, "coordinatesY": 2.0, "processingTimeMs": 100}


def test_names():
    assert [V.key_of(a()) for a in V.DEFAULT] == ["ring_detection", "unsharp_masking", "polar_ring_detection", "sobel_ring_detection", "autocorrelation_periodicity", "second_derivative_ring_detection", "k_means_ring_counter", "c_n_n_segmentation"]


@pytest.mark.parametrize("algorithm", [V.PolarRingDetection, V.SobelRingDetection, V.SecondDerivativeRingDetection, V.AutocorrelationPeriodicity])
@pytest.mark.parametrize(("image", "centre"), [(FLAT, (100, 100)), (TINY, (0, 0)), (DISC, (-500, 900)), (DISC, (0.0, 0.0)), (FLAT[..., 0], (100, 100))])
def test_nothing_to_find(algorithm, image, centre):
    got = algorithm().process(image, centre).payload
    assert got["ring_count"] == len(got["radii"])
    if image is not DISC:
        assert got["ring_count"] == 0


def test_votes_group_from_an_anchor():
    found = [(r, s) for r in (50, 55, 61) for s in range(4)]
    assert V.vote(found, 10, 4) == ([52, 61], [4, 4]) and V.vote(found[:3], 10, 4) == ([], []) and V.vote([], 10, 4) == ([], [])


def test_model_is_loaded_once():
    calls = []
    load = lambda path: calls.append(path) or V.dark_predictor
    assert V.cached_model("m", load) is V.cached_model("m", load) and calls == ["m"]
    with pytest.raises(ValueError, match="no URL"):
        V.download("", "/nonexistent/model")


def scanned(spark, images):
    rows = [(n, *i.shape[:2], 3, i.tobytes(), True, x, y) for n, i, x, y in images]
    return spark.createDataFrame(rows, "image string, height int, width int, channels int, data binary, ok boolean, x double, y double")


def test_images_through_spark(spark):
    rows = scanned(spark, [("disc", DISC, 200.0, 200.0), ("flat", FLAT, 100.0, 100.0)])
    broken = rows.limit(1).withColumns({"image": F.lit("broken"), "ok": F.lit(False)})

    class Fails:
        def process(self, image, centre, job=""):
            raise RuntimeError("no luck")

    out = {(r.image, r.algorithm): r for r in pipeline.run_images(rows.unionAll(broken), lambda: [V.SobelRingDetection(), Fails()]).collect()}
    assert out["disc", "sobel_ring_detection"].rings == 1 and abs(out["disc", "sobel_ring_detection"].radii[0] - 100) <= 2
    assert out["flat", "sobel_ring_detection"].rings == 0 and not out["broken", None].ok
    assert json.loads(out["disc", "fails"].payload) == {"error": "no luck", "status": "failed"}


def test_slices(spark):
    rows = scanned(spark, [("disc", DISC, 180.0, 220.0), ("none", FLAT, float("nan"), 1.0)])
    slices = pipeline.slice_images(rows, 3, 6)
    out = slices.collect()
    good = [r for r in out if r.status == "SUCCESS"]
    assert len(good) == 3 + 4 + 5 + 6 and [r.image for r in out if r.status != "SUCCESS"] == ["none"]
    for n in range(3, 7):
        whole = np.zeros(DISC.shape, np.uint16)
        for r in good:
            if r.n_slices == n:
                whole[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w] += I.decode_png(bytes(r.content))
        assert (whole == DISC).all()
    counts = spark.createDataFrame([("disc", 23)], "image string, rings_count int")
    labels = pipeline.slice_labels(slices, counts).collect()
    assert len(labels) == 18 and labels[0].rings_count == 23 and labels[0].image_path.startswith("processed/3/disc/disc_")
    report = {r.image: r for r in pipeline.slice_report(slices).collect()}
    assert report["disc"].slices == 18 and 0 < report["disc"].space_saved < 100 and report["none"].slices == 0


def test_overlay(spark):
    rows = scanned(spark, [("a", FLAT, 0.0, 0.0), ("b", FLAT, 0.0, 0.0)])
    notes = spark.createDataFrame([("a", [([[10.9, 10.0], [50.0, 10.0], [50.0, 60.0]],), (None,)])], "image_id string, shapes array<struct<points: array<array<double>>>>")
    out = {r.image: r for r in pipeline.overlay(rows, notes).collect()}
    assert out["b"].status.startswith("WARNING") and out["a"].status == "SUCCESS"
    drawn = I.decode_png(bytes(out["a"].content))
    assert drawn[10, 30].tolist() == [0, 255, 0] and drawn[100, 100].tolist() == [90] * 3


def test_registered_slices_have_every_resolution(spark):
    from collections import Counter

    from xylem.plans.queries import QUERIES

    rows = QUERIES["image_slices"](spark, "/root/testdata/sf0.001").collect()
    per_image = Counter(r.image for r in rows)
    assert per_image and set(per_image.values()) == {462} and {r.n_slices for r in rows} == set(range(3, 31))
