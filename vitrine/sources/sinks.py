"""Writes: replace whole partitions, append to ledgers, keep a run log. Tables that are merged or whose derived rows are
replaced are snapshots (vitrine.sources.snapshots)."""

from __future__ import annotations

import json
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Overwrites only the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Adds rows to an append-only ledger."""
    df.write.mode("append").parquet(path)


RUN = "source string, status string, started_at double, finished_at double, counts string, cursor string, error string"


@contextmanager
def run_log(spark: SparkSession, path: str, source: str):
    """Appends one row for a job run; the caller fills the dict. A failed run is logged and raises again."""
    told: dict = {"counts": {}, "cursor": None}
    began = time.time()

    def close(status: str, error: str | None) -> None:
        append(spark.createDataFrame([(source, status, began, time.time(), json.dumps(told["counts"], sort_keys=True), told["cursor"], error)], RUN), path)

    try:
        yield told
    except Exception as e:
        close("failed", str(e)[:400])
        raise
    close("completed", None)
