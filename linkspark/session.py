"""A session with the settings the queries assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[8]", **config: str) -> SparkSession:
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | config
    return SparkSession.builder.master(master).config(map=settings).getOrCreate()
