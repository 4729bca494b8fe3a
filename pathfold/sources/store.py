"""Index generations: write all tables anew, then point at them; state is an event log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathfold import schemas

VERSION = 1


class Store:
    """A folder with generations, a pointer table and the append-only state log."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def write_index(self, tables: dict[str, DataFrame]) -> str:
        """All or nothing: readers see the old generation until the pointer moves."""
        generation = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.folder}/generations/{generation}/{name}")
        pointer = self.spark.range(1).select(F.lit(VERSION).alias("version"), F.lit(generation).alias("generation"), F.current_timestamp().alias("at"))
        pointer.coalesce(1).write.mode("append").parquet(f"{self.folder}/pointer")
        return generation

    def current(self) -> str:
        row = self.spark.read.parquet(f"{self.folder}/pointer").orderBy(F.desc("at"), F.desc("generation")).first()
        if row["version"] > VERSION:
            raise ValueError("the index was written by a newer version")
        return row["generation"]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(schemas.INDEX[name]).parquet(f"{self.folder}/generations/{self.current()}/{name}")

    def record(self, events: DataFrame) -> None:
        """Append engagement events; counters are a view (operators.probes.engagement)."""
        events.write.mode("append").parquet(f"{self.folder}/state")

    def events(self) -> DataFrame:
        return self.spark.read.schema(schemas.ENGAGEMENT_EVENTS).parquet(f"{self.folder}/state")

    def purge(self) -> None:
        """Forget all state; the index stays."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def merge_coverage(rows: DataFrame) -> DataFrame:
    return rows.groupBy("test", "symbol").agg(F.max("fraction").alias("fraction"))


def merge_authorship(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path", "author").agg(F.sum("lines").alias("lines"), F.max("last_active").alias("last_active"))


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the first by an explicit order."""
    rest = [c for c in rows.columns if c not in keys]
    g = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__r"))
    return g.select(*keys, *(F.col(f"__r.{c}").alias(c) for c in rest))
