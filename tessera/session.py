"""SparkSession factory with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    build = SparkSession.builder.master(master).appName("tessera")
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": str(partitions), "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false"} | conf
    for k, v in settings.items():
        build = build.config(k, v)
    return build.getOrCreate()
