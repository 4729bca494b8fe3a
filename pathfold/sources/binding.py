"""The model's tables over a TPC-H-like schema (one fixed reading of its columns)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathfold.parts import deal
from pathfold.scratch import Scratch


@dataclass(frozen=True)
class View:
    """Lazy facts: orders are commits, parts are files, (part, supplier) are symbols."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def lines(self) -> int:
        return self.table("lineitem").count()

    @cached_property
    def now(self) -> DataFrame:
        return self.table("orders").agg(F.max("o_orderdate").alias("now"))

    @cached_property
    def commits(self) -> DataFrame:
        o = self.table("orders")
        return o.select(
            F.col("o_orderkey").alias("hash"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"),
            F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("corrective"), (F.col("o_orderstatus") == "P").alias("marked"),
        )

    @cached_property
    def commit_files(self) -> DataFrame:
        li = self.table("lineitem").select(F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("path"), "l_quantity")
        return deal(li, self.lines, "hash").groupBy("hash", "path").agg(F.sum("l_quantity").cast("long").alias("added"))

    @cached_property
    def files(self) -> DataFrame:
        p = self.table("part")
        return p.select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("package"), F.col("p_type").alias("dir"), F.col("p_size").alias("span"), (F.col("p_type") == "PROMO").alias("is_test"), (F.col("p_type") == "ECONOMY").alias("generated"))

    @cached_property
    def symbols(self) -> DataFrame:
        """(part, supplier) pairs; id part * 1000000 + supplier."""
        li = deal(self.table("lineitem").select("l_partkey", "l_suppkey"), self.lines, "l_partkey").distinct()
        return li.select((F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("symbol"), F.col("l_partkey").alias("path")).join(self.files, "path")

    @cached_property
    def call_sites(self) -> DataFrame:
        """Successive lines of an order call each other; static where the order is final."""
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
        li = deal(self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), self.lines, "l_orderkey")
        pairs = li.select("l_orderkey", F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
        final = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderstatus") == "F").alias("static"))
        return pairs.filter("dst IS NOT NULL AND src <> dst").join(final, "l_orderkey").select("src", "dst", "static")

    @cached_property
    def edges(self) -> DataFrame:
        return deal(self.call_sites.select("src", "dst"), self.lines, "src").distinct()

    @cached_property
    def edges_table(self) -> DataFrame:
        """The edges, written once for plans that read them again and again."""
        return Scratch(self.spark, "view").write(self.edges, "edges")

    @cached_property
    def imports(self) -> DataFrame:
        """Each brand imports the next by number."""
        k = F.regexp_extract("package", "#([0-9]+)", 1).cast("int")
        brand = self.files.select("package", k.alias("k")).distinct()
        following = brand.select(F.col("package").alias("to_pkg"), (F.col("k") - 1).alias("k"))
        return brand.join(following, "k").select(F.col("package").alias("from_pkg"), "to_pkg")

    @cached_property
    def authorship(self) -> DataFrame:
        last = self.commits.groupBy("author").agg(F.max("ts").alias("last_active"))
        known = self.commits.select("hash", "author").join(last, "author", "left")  # there are fewer commits than lines
        changes = deal(self.commit_files.join(known, "hash").select("path", "author", "last_active", "added"), self.lines, "path")
        return changes.groupBy("path", "author", "last_active").agg(F.sum("added").alias("lines")).select("author", "path", "lines", "last_active")

    def windowed(self, days: int) -> DataFrame:
        """Commits with ts >= now - days, with `now`."""
        one = F.broadcast(self.now)  # one row
        return self.commits.crossJoin(one).filter(F.col("ts") >= F.col("now") - F.expr(f"INTERVAL {days} DAYS"))
