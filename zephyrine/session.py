"""The session the engine expects: UTC, adaptive execution, ANSI semantics."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "zephyrine", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return b.config(map=base | conf).getOrCreate()
