"""The Spark session of jobs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: What every job sets; callers may override.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str, conf: dict[str, str] | None = None, master: str | None = None) -> SparkSession:
    """A session named app; the master comes from the argument, SPARK_MASTER_URL or, failing both, the launcher."""
    builder = SparkSession.builder.appName(app)
    if master := master or os.environ.get("SPARK_MASTER_URL"):
        builder = builder.master(master)
    return builder.config(map=DEFAULTS | (conf or {})).getOrCreate()
