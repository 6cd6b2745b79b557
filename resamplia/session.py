"""Session helpers."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, memory: str = "16g", **conf: str) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    settings = {
        "spark.driver.memory": memory,
        "spark.driver.host": "127.0.0.1",
        "spark.driver.bindAddress": "127.0.0.1",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cpus),
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("resamplia")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

