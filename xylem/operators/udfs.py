"""Python task surfaces."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame


def slow_task(numbers: DataFrame, seconds: float = 0.1) -> DataFrame:
    """(id, doubled) of (id): waits for each row, to measure how tasks scale."""

    def doubled(batches):
        for pdf in batches:
            time.sleep(seconds * len(pdf))
            yield pdf.assign(doubled=pdf.id * 2)

    return numbers.mapInPandas(doubled, "id long, doubled long")


def mock_results(jobs: DataFrame, now: str) -> DataFrame:
    """(value): the result of the processor that only goes through the motions, for each job (jobId, file, clientId, x, y)."""
    import json

    from xylem.operators.vision import mock_result

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"value": [json.dumps(mock_result(r.jobId, r.file, r.clientId, r.x, r.y, now)) for r in pdf.itertuples()]})

    return jobs.select("jobId", "file", "clientId", "x", "y").mapInPandas(run, "value string")


class Slices:
    """Table function slices(low, high): a row (n_slices, slice_no) for each slice of each resolution."""

    def eval(self, low: int, high: int):
        for n in range(low, high + 1):
            for k in range(1, n + 1):
                yield n, k


def register(spark) -> None:
    """Makes the table function known to SQL: select * from slices(3, 30)."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("slices", udtf(Slices, returnType="n_slices int, slice_no int"))
