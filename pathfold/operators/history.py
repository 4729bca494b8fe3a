"""Signals of commit history: churn, fixes, orphaned and machine-assisted lines, authors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathfold.functions import scalar


def churn(changes: DataFrame) -> DataFrame:
    """path, churn. changes: path, ts, now and optionally renamed (the old path); the weight
    of a rename goes to both paths."""
    w = changes.withColumn("w", scalar.recency_weight(F.col("ts"), F.col("now")))
    if "renamed" in changes.columns:
        w = w.withColumn("path", F.explode(F.array_compact(F.array("path", F.nullif("renamed", F.lit(""))))))
    return w.groupBy("path").agg(F.sum("w").alias("churn"))


def fix_density(changes: DataFrame) -> DataFrame:
    """path, fix_density: corrective share times ln(1 + corrective); no row without any."""
    g = changes.groupBy("path").agg(F.count_if(F.col("corrective")).alias("fixes"), F.count(F.lit(1)).alias("commits"))
    return g.filter("fixes > 0").select("path", scalar.share_log(F.col("fixes"), F.col("commits")).alias("fix_density"))


def orphaning(authorship: DataFrame, now: DataFrame) -> DataFrame:
    """path, orphaned_share, orphaning; all history, unknown authors count as gone."""
    gone = scalar.is_orphaned(F.col("last_active"), F.col("now"))
    a = authorship.crossJoin(F.broadcast(now))  # one row
    g = a.groupBy("path").agg(F.sum(F.when(gone, F.col("lines")).otherwise(0)).alias("orphaned"), F.sum("lines").alias("total"))
    return g.filter("total > 0").select("path", (F.col("orphaned") / F.col("total")).alias("orphaned_share"), scalar.share_log(F.col("orphaned"), F.col("total")).alias("orphaning"))


def ai_density(changes: DataFrame) -> DataFrame:
    """path, ai_density by added lines; no rows at all when no change is marked."""
    g = changes.groupBy("path").agg(F.sum(F.when(F.col("marked"), F.col("added")).otherwise(0)).alias("ai"), F.sum("added").alias("total"))
    return g.filter("ai > 0 AND total > 0").select("path", scalar.share_log(F.col("ai"), F.col("total")).alias("ai_density"))


def derive_authorship(commits: DataFrame, files: DataFrame, activity: DataFrame) -> DataFrame:
    """path, author, lines, last_active: added lines per author; nameless authors are skipped."""
    c = commits.filter("author IS NOT NULL AND author <> ''").select("hash", "author")
    return files.join(c, "hash").groupBy("path", "author").agg(F.sum("added").alias("lines")).join(activity, "author", "left")


def author_activity(log: DataFrame) -> DataFrame:
    """author, last_active over all history, merges included; keyed by trimmed lower e-mail."""
    return log.groupBy(F.lower(F.trim("author_email")).alias("author")).agg(F.max("ts").alias("last_active"))


def most_churned(changes: DataFrame) -> DataFrame:
    return changes.groupBy("path").agg(F.count(F.lit(1)).cast("double").alias("value"))


def most_recent(changes: DataFrame) -> DataFrame:
    return changes.groupBy("path").agg(F.unix_seconds(F.max("ts").cast("timestamp")).cast("double").alias("value"))


def most_authors(changes: DataFrame) -> DataFrame:
    return changes.groupBy("path").agg(F.count_distinct("author").cast("double").alias("value"))


def largest_files(symbols: DataFrame) -> DataFrame:
    """path, value: summed line spans of the symbols that are not tests."""
    return symbols.filter("NOT is_test").groupBy("path").agg(F.sum("span").cast("double").alias("value"))


def only_indexed(scores: DataFrame, symbols: DataFrame) -> DataFrame:
    """Positive scores of files with a symbol that is not a test."""
    return scores.filter("value > 0").join(symbols.filter("NOT is_test").select("path").distinct(), "path", "left_semi")


def collapse(scores: DataFrame, how: str = "mean") -> DataFrame:
    """Symbol scores to files; only positive scores enter. how: max, mean or sum."""
    f = {"max": F.max, "mean": F.avg, "sum": F.sum}[how]
    return scores.filter("score > 0").groupBy("path").agg(f("score").alias("value"))


def mark_assisted(commits: DataFrame, notes: DataFrame) -> DataFrame:
    """marked is also true where a note names the commit."""
    n = notes.select("hash").distinct().withColumn("__note", F.lit(True))
    return commits.join(n, "hash", "left").withColumn("marked", F.col("marked") | F.coalesce("__note", F.lit(False))).drop("__note")
