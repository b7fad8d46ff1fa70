"""A session with the settings that the engine's plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, **conf) -> SparkSession:
    b = SparkSession.builder.appName("arterial")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
                 "spark.ui.enabled": "false", **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()
