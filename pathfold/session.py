"""Session factory: UTC, ANSI, adaptive execution."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "pathfold", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators assume; existing sessions are reused."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PATHFOLD_DRIVER_MEMORY", "8g"))
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
