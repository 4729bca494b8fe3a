"""Explicit numbers of partitions: what a task holds stays the same as tables grow.

Adaptive execution joins small partitions to one for each core, so without them a task's
sorts and hash maps grow with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Narrow rows that one task sorts or groups, about.
PER_TASK = 500_000


def parts(spark: SparkSession, rows: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-rows // PER_TASK))


def deal(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by keys, in as many partitions as so many rows need."""
    return df.repartition(parts(df.sparkSession, rows), *keys)
