"""Images, listings and side tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem import schemas
from xylem.functions.columns import base_name, stem
from xylem.functions.image import decode_png


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """(image, path, height, width, channels, data, ok) of the PNG and JPEG files under path, decoded in the JVM; a file that is no picture has ok false."""
    i = spark.read.format("image").option("pathGlobFilter", "*.{[pP][nN][gG],[jJ][pP][gG],[jJ][pP][eE][gG]}").load(path).select("image.*")
    name = base_name(F.col("origin"))
    return i.select(stem(name).alias("image"), F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("channels"), "data", (F.col("height") > 0).alias("ok"))


def stream_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.IMAGE_FILE).format("image").load(path).select("image.*")


def list_files(spark: SparkSession, path: str, extension: str | None = None, limit: int | None = None) -> DataFrame:
    """(path, name, length) by name; contents are not read. The first `limit` names, or all."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if extension:
        reader = reader.option("pathGlobFilter", "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in extension.lstrip(".")))
    rows = reader.load(path).select("path", base_name(F.col("path")).alias("name"), "length").orderBy("name")
    return rows if limit is None else rows.limit(limit)


def as_array(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """An image row's bytes as an array, blue first; alpha is dropped."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return a[..., 0] if channels == 1 else a[..., :3]


def read_pith(spark: SparkSession, path: str, swap_xy: bool = True) -> DataFrame:
    """(image, x, y) of a CSV Image,cx,cy. Its cx is the row and its cy the column unless swap_xy is off."""
    rows = spark.read.csv(path, header=True, schema=schemas.PITH)
    x, y = ("cy", "cx") if swap_xy else ("cx", "cy")
    return rows.select(F.col("Image").alias("image"), F.col(x).alias("x"), F.col(y).alias("y"))


def read_centres(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schemas.CENTRE).withColumnRenamed("codigo_imagen", "image")


def read_ring_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schemas.RING_COUNTS).withColumnRenamed("image_code", "image")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, shapes) of JSON files, one per image; a file that is no JSON has null shapes."""
    rows = spark.read.schema(schemas.ANNOTATION).json(path, multiLine=True, pathGlobFilter="*.json")
    return rows.select(stem(base_name(F.input_file_name())).alias("image_id"), "shapes")


def resolve_centre(given_x: Column, given_y: Column, csv_x: Column, csv_y: Column, auto_x: Column, auto_y: Column) -> tuple[Column, Column]:
    """Given coordinates, or else those on file, or else those found."""
    return F.coalesce(given_x, csv_x, auto_x), F.coalesce(given_y, csv_y, auto_y)


Opener = Callable[[str], bytes]


def open_url(url: str, timeout: float = 10.0) -> bytes:
    """The bytes at a URL (http, https or file); any failure raises."""
    from urllib.request import urlopen

    with urlopen(url, timeout=timeout) as answer:  # noqa: S310 - schemes are the caller's
        return answer.read()


def fetch(url: str, opener: Opener = open_url) -> np.ndarray | None:
    """The image at a URL; None for any failure."""
    try:
        return decode_png(opener(url))
    except Exception:  # noqa: BLE001 - whatever the opener raises, the job is to report it
        return None


def fetch_bytes(urls: DataFrame, url_col: str = "url", opener: Opener = open_url, threads: int = 8) -> DataFrame:
    """urls with content (null where it failed) and error. Threads of one task share its batch."""

    def run(batches: Iterator) -> Iterator:
        def one(url):
            try:
                return opener(url), None
            except Exception as e:  # noqa: BLE001
                return None, f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                got = list(pool.map(one, pdf[url_col]))
                yield pdf.assign(content=[g[0] for g in got], error=[g[1] for g in got])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema)
    return urls.mapInPandas(run, f"{fields}, content binary, error string")
