"""The job stream as a program: python -m xylem --help."""

from __future__ import annotations

import argparse

from xylem.config import KafkaConfig, kafka_package
from xylem.plans.pipeline import run_jobs
from xylem.session import get_session
from xylem.sinks.objects import UriStore
from xylem.streaming import jobs


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="xylem", description="Reads image jobs from a topic, or from files of a folder, and writes their results.")
    p.add_argument("--messages", help="folder of text files, one message a line; without it, the topic of KAFKA_TOPIC_INGESTION")
    p.add_argument("--out", help="folder for the results as text files; without it, the topic of KAFKA_TOPIC_RESULTS")
    p.add_argument("--checkpoint", required=True, help="folder that driver and executors share")
    p.add_argument("--store", help="URI under which rendered images go; without it they are not stored")
    p.add_argument("--domain", default="objects.invalid", help="domain of the images' public URLs")
    p.add_argument("--partitions", type=int, default=3, help="tasks of a batch, which bounds the copies of a model")
    p.add_argument("--once", action="store_true", help="what is there now, then end")
    return p.parse_args(given)


def main(given: list[str] | None = None) -> None:
    a = arguments(given)
    import pyspark

    kafka = not a.messages or not a.out
    spark = get_session("xylem", {"spark.jars.packages": kafka_package(pyspark.__version__)} if kafka else None)
    config = KafkaConfig()
    stream = spark.readStream.text(a.messages) if a.messages else jobs.message_stream(spark, config)
    store = UriStore(a.store) if a.store else None
    out = jobs.results(stream, lambda batch: run_jobs(batch, store=store, domain=a.domain), a.partitions)
    jobs.await_and_stop(jobs.start(out, "text" if a.out else "kafka", a.checkpoint, config, a.once, a.out))


if __name__ == "__main__":
    main()
