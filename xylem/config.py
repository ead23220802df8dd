"""Options of the message stream and of the object store."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


def _env(name: str, default: str):
    return field(default_factory=lambda: os.environ.get(name, default))


@dataclass(frozen=True)
class KafkaConfig:
    bootstrap_servers: str = _env("KAFKA_BOOTSTRAP_SERVERS", "localhost:9092")
    ingestion_topic: str = _env("KAFKA_TOPIC_INGESTION", "image-ingestion")
    results_topic: str = _env("KAFKA_TOPIC_RESULTS", "processing-results")
    group_id: str = _env("KAFKA_GROUP_ID", "spark-image-processor")

    def read_options(self) -> dict[str, str]:
        return {"kafka.bootstrap.servers": self.bootstrap_servers, "subscribe": self.ingestion_topic, "startingOffsets": "earliest", "failOnDataLoss": "false", "kafka.group.id": self.group_id}

    def write_options(self) -> dict[str, str]:
        return {"kafka.bootstrap.servers": self.bootstrap_servers, "topic": self.results_topic}


def kafka_package(spark_version: str, scala: str = "2.13") -> str:
    """Coordinate of the connector that goes with a Spark version."""
    return f"org.apache.spark:spark-sql-kafka-0-10_{scala}:{spark_version}"


@dataclass(frozen=True)
class StoreConfig:
    """Where objects go (any URI that Spark's file systems reach) and how their public URLs look."""

    base: str
    url_template: str = "https://{domain}/{key}"
    domain: str = "objects.invalid"
    options: dict[str, str] = field(default_factory=dict)

    def url(self, key: str, bucket: str = "") -> str:
        return self.url_template.format(domain=self.domain, key=key, bucket=bucket)

    def hadoop_options(self) -> dict[str, str]:
        return {f"spark.hadoop.{k}": v for k, v in self.options.items()}
