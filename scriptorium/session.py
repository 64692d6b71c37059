"""The session settings that every entry point of the library expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "scriptorium", cores: str | None = None, partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the launcher's own session is used as it is."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores or os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
