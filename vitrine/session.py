"""Session defaults: UTC and adaptive execution; sizes of shuffles are left to the cluster and to AQE."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "vitrine", **conf) -> SparkSession:
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return SparkSession.builder.appName(app).config(map=base | conf).getOrCreate()
