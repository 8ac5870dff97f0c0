"""The folder that the driver and all executors share, and tables written there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Local folders of this process, which go with it.
_LOCAL: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder: spark.checkpoint.dir, or a new local one where it is unset and the executors are threads of
    this process. What is written there stays for the caller to clear, as results read it."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="vitrine-checkpoint-", ignore_cleanup_errors=True))
        told = "file://" + _LOCAL[-1].name
        spark.conf.set("spark.checkpoint.dir", told)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(told)
    return told


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path, not made yet, in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, which takes less room there than a checkpoint and cuts lineage as well."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
