"""Exact dedup by distributed MSD radix partitioning.

A round reads the next digit (a run of successive bytes) of every text that still has
company, splits each group by it, and goes on with the groups that have several rows and
more bytes. Digits widen by a factor, so the rounds are logarithmic in the longest text.
Equality is decided by the bytes alone; the SHA-256 is only reported.

Edge cases: a null text counts as empty; an empty table gives an empty result; rows
without an id never win against one with an id; of rows that repeat both id and text one
is kept; columns other than the two named are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathfold.llm.columns import column, spare
from pathfold.scratch import Scratch

#: Bytes of digits that are broadcast to find the rows of great groups; tasks for each group.
HOT_BYTES, FAN = 4 << 20, 64
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text):
    """Lower-case A-Z only. Texts of one-byte characters take the fast built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def partitions(rows: DataFrame, scratch: Scratch, width: int, growth: int) -> DataFrame:
    """id, sha, keep_id (the greatest id of the equal texts), n (how many they are).

    rows: id, sha, rest (the bytes). width: bytes of the first digit; growth: by how much each
    digit is wider than the last. Groups are counted before the shuffle. The rows of the
    greatest groups (1,024 at most, and no more than HOT_BYTES of digits, so they are
    broadcast) are dealt to FAN tasks each.
    """
    ended, level, total = [], 0, rows.count()
    rows = rows.withColumn("node", F.lit(0).cast("long"))
    while True:
        cut = rows.select("id", "node", "sha", F.substring("rest", 1, width).alias("digit"), F.expr(f"substring(rest, {width + 1})").alias("rest"))
        groups = cut.groupBy("node", "digit").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        groups = groups.withColumn("open", F.octet_length("digit") == width).withColumn("next", F.monotonically_increasing_id())
        groups = scratch.write(groups, f"groups{level}")
        going_on = not groups.filter("open").isEmpty()
        if most := min(1024, HOT_BYTES // width):
            great = F.col("n") > total // most
            hot = groups.filter(great).select("node", "digit", F.lit(True).alias("hot"))
            cut = cut.join(F.broadcast(hot), ["node", "digit"], "left")
            cut = cut.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(FAN))).otherwise(F.lit(0))).drop("hot")
            groups = groups.withColumn("salt", F.explode(F.when(great, F.sequence(F.lit(0), F.lit(FAN - 1))).otherwise(F.array(F.lit(0)))))
        on = ["node", "digit", *["salt"] * bool(most)]
        split = cut.join(groups.hint("shuffle_hash"), on, "left").select(
            "id", "sha",
            F.coalesce("open", F.lit(False)).alias("open"),
            F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("n"),
            F.col("next").alias("node"),
            F.when(F.col("open"), F.col("rest")).alias("rest"),
        )
        split = scratch.write(split, f"rows{level}")
        ended.append(split.filter("not open").select("id", "sha", "keep_id", "n"))
        if not going_on:
            return reduce(DataFrame.unionAll, ended)
        rows = split.filter("open").select("id", "sha", "rest", "node")
        width, level = width * growth, level + 1


def normalised(text_col: str):
    return F.coalesce(ascii_lower(column(text_col).cast("string")), F.lit("")).cast("binary")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 32, growth: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(docs.sparkSession, "radix")
    rows = docs.select(column(id_col).alias("id"), normalised(text_col).alias("rest"))
    rows = rows.select("id", F.unhex(F.sha2("rest", 256)).alias("sha"), "rest")
    out = partitions(rows, scratch, width, growth)
    out = out.select(F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), F.lower(F.hex("sha")).alias("text_sha256"))
    same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    first = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy(F.lit(1))) == 1
    sure = out.filter(~same | (F.col("group_size") == 1)).withColumn("kept", same)
    tied = out.filter(same & (F.col("group_size") > 1)).withColumn("kept", first)
    return sure.unionByName(tied).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns whatever their names, of which one stays per distinct
    text: that of the greatest id, and of rows that share it the last of the table."""
    scratch = Scratch(docs.sparkSession, "radix")
    (row,) = spare(docs, "row")
    named = scratch.write(docs.withColumn(row, F.monotonically_increasing_id()), "named")
    rows = named.select(F.struct(column(id_col).alias("doc"), F.col(row).alias("row")).alias("id"), F.lit(None).cast("binary").alias("sha"), normalised(text_col).alias("rest"))
    kept = partitions(rows, scratch, 32, 4).filter("id = keep_id").select(F.col("id.row").alias(row))
    return named.join(kept, row, "left_semi").select(*map(column, docs.columns))


QUERY = "op5_exact_dedup"


def query(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
