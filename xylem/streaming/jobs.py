"""The job stream: messages in, algorithms over their images, results out, in one plan per micro-batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from xylem.config import KafkaConfig
from xylem.operators.jobs import parse_messages, with_coordinates


def message_stream(spark: SparkSession, config: KafkaConfig) -> DataFrame:
    """The topic's values (needs the Kafka connector; tests and replays pass a file or memory stream instead)."""
    return spark.readStream.format("kafka").options(**config.read_options()).load().select("value")


def results(stream: DataFrame, pipeline: Callable[[DataFrame], DataFrame], partitions: int | None = None) -> DataFrame:
    """(value) of (value): parsed, dealt over so many partitions (which bounds the copies of a model), run, as JSON."""
    parsed = with_coordinates(parse_messages(stream))
    return pipeline(parsed.repartition(partitions) if partitions else parsed)


def start(out: DataFrame, sink: str | Callable, checkpoint: str, config: KafkaConfig | None = None, available_now: bool = False, path: str | None = None) -> StreamingQuery:
    """Starts the query: sink is `kafka`, `console`, a file format, or a function of (batch, batch_id).

    At least once: a batch that is replayed is written again, under the same object keys.
    """
    writer = out.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if callable(sink):
        writer = writer.foreachBatch(sink)
    elif sink == "kafka":
        writer = writer.format("kafka").options(**(config or KafkaConfig()).write_options())
    else:
        writer = writer.format(sink)
        writer = writer.option("path", path) if path else writer
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def await_and_stop(query: StreamingQuery) -> None:
    try:
        query.awaitTermination()
    except KeyboardInterrupt:
        pass
    finally:
        query.stop()


def once_per_job(batch: DataFrame, key: str = "jobId") -> DataFrame:
    """Within a batch, one row per job; rows without one all stay."""
    return batch.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(batch.where(F.col(key).isNull()))


def run_once(stream: DataFrame, root: str) -> DataFrame:
    """All that is there now, through a file sink under root; read back as a table."""
    place = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = start(stream, "parquet", f"{place}/checkpoint", available_now=True, path=f"{place}/out")
    await_and_stop(query)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{place}/out")
