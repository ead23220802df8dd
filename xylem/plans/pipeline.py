"""Batch plans over images: algorithms, slices and overlays, each one mapInPandas over the scanned images."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.functions import image as I  # noqa: N812
from xylem.operators import vision
from xylem.sinks.objects import Store
from xylem.sources.images import Opener, as_array, fetch, open_url


def utc_now() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat()


def envelope(job, client, url, x: float, y: float, results: dict | None, error: str | None, now: str) -> dict:
    data = None if error else {"originalUrl": url, "metadata": {"coordinatesX": x, "coordinatesY": y}, "results": results}
    return {"jobId": job, "clientId": client, "status": "FAILED" if error else "COMPLETED", "timestamp": now, "data": data, "error": error}


def put_image(image, job: str, key: str, suffix: str, store: Store | None, domain: str) -> tuple[str, bool]:
    """URL of a rendered image, and whether it was stored; a failed upload keeps a placeholder."""
    name = f"app/results/{job}_{key}{suffix}.png"
    try:
        if store is not None:
            store(name, I.encode_png(image))
        return f"https://{domain}/{name}", store is not None
    except Exception:  # noqa: BLE001 - a failed upload does not fail the job
        return f"https://{domain}/placeholder/{name}", False


def run_algorithms(image, centre, job: str, algorithms: list, store: Store | None, domain: str) -> dict:
    """{key: payload}; an algorithm that raises has its error under its key and does not fail the job."""
    out = {}
    for algorithm in algorithms:
        key = vision.key_of(algorithm)
        try:
            got = algorithm.process(image, centre, job)
            payload = dict(got.payload)
            if got.visual is not None:
                payload["imageUrl"], payload["upload_ok"] = put_image(got.visual, job, key, "", store, domain)
            if got.mask is not None:
                payload["maskUrl"], _ = put_image(got.mask, job, key, "_mask", store, domain)
            out[key] = payload
        except Exception as e:  # noqa: BLE001
            out[key] = {"error": str(e), "status": "failed"}
    return out


def run_jobs(jobs: DataFrame, make: Callable[[], list] = lambda: [a() for a in vision.DEFAULT], opener: Opener = open_url, store: Store | None = None, domain: str = "objects.invalid", now: Callable[[], str] = utc_now) -> DataFrame:
    """(value): the result of each job (jobId, file, clientId, x, y, corrupt) as JSON, in one pass over the stream or table.

    make() runs once per partition. A message that was none is a FAILED result with what it said; so is an image that
    cannot be fetched.
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        algorithms = make()
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                text = lambda v: None if v is None or v != v else v
                job, client, url = text(row.jobId), text(row.clientId), text(row.file)
                image = fetch(url, opener) if url and text(row.corrupt) is None else None
                error = f"Not a job message: {row.corrupt}" if text(row.corrupt) is not None else "Failed to download image" if image is None else None
                results = run_algorithms(image, (row.x, row.y), str(job), algorithms, store, domain) if error is None else None
                out.append(json.dumps(envelope(job, client, url, row.x, row.y, results, error, now())))
            yield pd.DataFrame({"value": out})

    return jobs.select("jobId", "file", "clientId", "x", "y", "corrupt").mapInPandas(run, "value string")


def run_images(images: DataFrame, make: Callable[[], list] = lambda: [a() for a in vision.DEFAULT], partitions: int | None = None) -> DataFrame:
    """(image, algorithm, ok, rings, radii, payload) of scanned images (image, height, width, channels, data, ok, x, y).

    Few images take long, so their bytes say little about the work: `partitions` deals them out.
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        algorithms = make()
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                if not r.ok:
                    out.append((r.image, None, False, None, None, json.dumps({"error": "not an image"})))
                    continue
                results = run_algorithms(as_array(r.height, r.width, r.channels, r.data), (r.x, r.y), r.image, algorithms, None, "objects.invalid")
                for key, p in results.items():
                    radii = p.get("radii", p.get("radios_anillos"))
                    rings = p.get("ring_count", p.get("num_anillos", p.get("count")))
                    out.append((r.image, key, "error" not in p, rings, radii and [float(v) for v in radii], json.dumps(p)))
            frame = pd.DataFrame(out, columns=["image", "algorithm", "ok", "rings", "radii", "payload"])
            yield frame.assign(rings=frame.rings.astype("Int64"))

    rows = images.select("image", "height", "width", "channels", "data", "ok", "x", "y")
    return (rows.repartition(partitions) if partitions else rows).mapInPandas(run, "image string, algorithm string, ok boolean, rings long, radii array<double>, payload string")


SLICE = "image string, n_slices int, slice_no int, key string, x0 int, y0 int, w int, h int, original_pixels long, kept_pixels long, content binary, status string"


def slice_images(images: DataFrame, low: int = 3, high: int = 30) -> DataFrame:
    """A row per slice (SLICE) of images (image, height, width, channels, data, ok, x, y); an image that fails has one row of status ERROR.

    A task holds one image and yields its slices resolution by resolution.
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        columns = [c.split()[0] for c in SLICE.split(", ")]
        for pdf in batches:
            for r in pdf.itertuples():
                if not r.ok or r.x != r.x or r.y != r.y or r.x is None or r.y is None:
                    reason = "not an image" if not r.ok else "no centre"
                    yield pd.DataFrame([(r.image, 0, 0, None, 0, 0, 0, 0, 0, 0, None, f"ERROR: {reason}")], columns=columns)
                    continue
                image = as_array(r.height, r.width, r.channels, r.data)
                for n in range(low, high + 1):
                    out = []
                    for k in range(n):
                        mask = I.sector_mask(r.height, r.width, r.x, r.y, n, k)
                        y, x = np.nonzero(mask)
                        if not len(x):
                            continue
                        y0, y1, x0, x1 = int(y.min()), int(y.max()) + 1, int(x.min()), int(x.max()) + 1
                        part = image[y0:y1, x0:x1].copy()
                        part[~mask[y0:y1, x0:x1]] = 0
                        out.append((r.image, n, k + 1, f"processed/{n}/{r.image}/{r.image}_{k + 1}.png", x0, y0, x1 - x0, y1 - y0, image.shape[0] * image.shape[1], (y1 - y0) * (x1 - x0), I.encode_png(part), "SUCCESS"))
                    yield pd.DataFrame(out, columns=columns)

    return images.select("image", "height", "width", "channels", "data", "ok", "x", "y").mapInPandas(run, SLICE)




def slice_labels(slices: DataFrame, ring_counts: DataFrame) -> DataFrame:
    """(image_path, rings_count) of the slices that were made, for images whose count is known."""
    return slices.where("status = 'SUCCESS'").join(ring_counts, "image").select(F.col("key").alias("image_path"), "rings_count")


def slice_report(slices: DataFrame) -> DataFrame:
    """(image, slices, bytes, space_saved, status) by image."""
    original, kept = F.sum("original_pixels"), F.sum("kept_pixels")
    saved = F.when(original > 0, 100.0 * (original - kept) / original).otherwise(0.0)
    return slices.groupBy("image").agg(F.count_if(F.col("status") == "SUCCESS").alias("slices"), F.sum(F.length("content")).alias("bytes"), saved.alias("space_saved"), F.max("status").alias("status"))


def overlay(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """(image, status, content): rings drawn on images; without annotations the image is a WARNING, without pixels an ERROR."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                shapes = [] if r.shapes is None else [[(int(p[0]), int(p[1])) for p in s["points"]] for s in r.shapes if s["points"] is not None and len(s["points"])]
                if not r.ok or not shapes:
                    out.append((r.image, "WARNING: no rings" if r.ok else "ERROR: not an image", None))
                    continue
                drawn = I.colour(as_array(r.height, r.width, r.channels, r.data))
                for points in shapes:
                    I.draw_polygon(drawn, points)
                out.append((r.image, "SUCCESS", I.encode_png(drawn)))
            yield pd.DataFrame(out, columns=["image", "status", "content"])

    joined = images.join(annotations.select(F.col("image_id").alias("image"), "shapes"), "image", "left")
    return joined.select("image", "height", "width", "channels", "data", "ok", "shapes").mapInPandas(run, "image string, status string, content binary")
