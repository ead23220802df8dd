"""Writers of objects, tables and manifests.

Objects go through a store: a function of (key, bytes) that runs on the executors. UriStore writes to an object store or
any other file system with a URI, LocalStore under a folder that all executors mount; write_objects() needs no store, but
keeps its rows as Parquet, on any file system that Spark has.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Store = Callable[[str, bytes], None]


@dataclass(frozen=True)
class LocalStore:
    """Files under a folder; a key written again is replaced whole."""

    base: str

    def __call__(self, key: str, data: bytes) -> None:
        path = os.path.join(self.base, key)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        partial = f"{path}.{os.getpid()}.tmp"
        with open(partial, "wb") as f:
            f.write(data)
        os.replace(partial, path)


@dataclass(frozen=True)
class UriStore:
    """Objects under a URI (file, s3, gs, hdfs); a key written again is replaced whole.

    options are those of the file system (for s3: access_key, secret_key, endpoint_override, region ...), metadata is
    kept with each object where the file system has any. Each process opens the file system once.
    """

    base: str
    options: tuple[tuple[str, str], ...] = ()
    metadata: tuple[tuple[str, str], ...] = ()

    def _place(self):
        from pyarrow import fs

        base = self.base.rstrip("/")
        if self.options and base.startswith("s3"):
            return fs.S3FileSystem(**dict(self.options)), base.split("://", 1)[1]
        return fs.FileSystem.from_uri(base)

    def __call__(self, key: str, data: bytes) -> None:
        store, root = _OPEN.get(self) or _OPEN.setdefault(self, self._place())
        path = f"{root}/{key}"
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        if store.type_name != "local":  # an object appears whole when its stream ends
            with store.open_output_stream(path, metadata=dict(self.metadata) or None) as f:
                f.write(data)
            return
        partial = f"{path}.{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(partial) as f:
            f.write(data)
        store.move(partial, path)


_OPEN: dict = {}


def put_all(objects: DataFrame, store: Store, threads: int = 32) -> DataFrame:
    """(key, bytes, ok, error) of (key, content): every object put, by so many threads in each task."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        def one(key, content):
            try:
                store(key, bytes(content))
                return key, len(content), True, None
            except Exception as e:  # noqa: BLE001 - reported by row
                return key, 0, False, f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                yield pd.DataFrame(list(pool.map(one, pdf["key"], pdf["content"])), columns=["key", "bytes", "ok", "error"])

    return objects.select("key", "content").mapInPandas(run, "key string, bytes long, ok boolean, error string")


def upload_folder(spark: SparkSession, path: str, prefix: str, store: Store, extension: str | None = None) -> DataFrame:
    """(key, bytes, ok, error): every file under path, to prefix/ and its place under path, so files of one name stay apart."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if extension:
        reader = reader.option("pathGlobFilter", f"*.{extension.lstrip('.')}")
    files, place = reader.load(path), spark._jvm.org.apache.hadoop.fs.Path(path)
    root = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri().getPath().rstrip("/")
    inner = F.expr("regexp_replace(path, '^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?', '')")
    return put_all(files.select(F.concat(F.lit(prefix.rstrip("/")), F.substring(inner, len(root) + 1, 1 << 30)).alias("key"), "content"), store)


def manifest(uploaded: DataFrame, domain: str) -> DataFrame:
    """(filename, url) of what was uploaded."""
    ok = uploaded.where("ok")
    return ok.select(F.regexp_extract("key", "([^/]*)$", 1).alias("filename"), F.concat(F.lit(f"https://{domain}/"), "key").alias("url"))


def upload_manifest(uploaded: DataFrame, domain: str, key: str, store: Store) -> DataFrame:
    """The manifest of what was uploaded, itself an object: JSON lines, in parts key-0, key-1, ... of a task each."""
    lines = manifest(uploaded, domain).select(F.to_json(F.struct("filename", "url")).alias("line"), F.spark_partition_id().alias("part"))
    body = lines.groupBy("part").agg(F.concat(F.array_join(F.sort_array(F.collect_list("line")), "\n"), F.lit("\n")).cast("binary").alias("content"))
    return put_all(body.select(F.concat(F.lit(f"{key}-"), "part").alias("key"), "content"), store)


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """CSV with a header; `single` makes one file, which is for small reports."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def write_objects(objects: DataFrame, path: str, partition: str | None = None) -> None:
    writer = objects.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def copy_file(spark: SparkSession, path: str, key: str, store: Store) -> DataFrame:
    return put_all(spark.read.format("binaryFile").load(path).select(F.lit(key).alias("key"), "content"), store, 1)


def purge(spark: SparkSession, path: str, confirm: bool = False) -> int:
    """Deletes all under path and returns how many files that were; what could not be deleted is an error that names it.

    Only with confirm=True; never called by a pipeline.
    """
    if not confirm:
        raise ValueError("purge() deletes everything under the path: call it with confirm=True")
    n = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").count()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.delete(p, True) and files.exists(p):
        raise OSError("not deleted: " + ", ".join(str(s.getPath()) for s in files.listStatus(p)))
    return n
