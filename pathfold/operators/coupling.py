"""Co-change mining: files that change together though nothing static joins them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathfold.parts import deal
from pathfold.scratch import Scratch


def pairs(changes: DataFrame, indexed: DataFrame, most_files: int = 20, least_support: int = 3, rows: int | None = None) -> DataFrame:
    """a, b, together, strength. changes: hash, path within the window; indexed: path. rows:
    how many changes there are at most, if they are dealt by hash (else they are written).

    Commits of more than most_files paths count as touches but make no pairs, which bounds
    the self-join. Pairs are dealt by both paths before they are counted, and only those with
    support meet the index and the touch counts.
    """
    scratch = Scratch(changes.sparkSession, "pairs")
    c = changes.select("hash", "path").distinct()
    if rows is None:
        c = scratch.write(c, "changes")
        rows = c.count()
        c = deal(c, rows, "hash")
    touched = c.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    size = c.groupBy("hash").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k").between(2, most_files))
    x, y = c.join(size.select("hash"), "hash", "left_semi").alias("x"), c.alias("y")
    both = x.join(y, (F.col("x.hash") == F.col("y.hash")) & (F.col("x.path") < F.col("y.path"))).select(F.col("x.path").alias("a"), F.col("y.path").alias("b"))
    g = deal(both, 3 * rows, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("together")).filter(F.col("together") >= least_support)
    g = scratch.write(g, "supported")
    ends = g.select(F.explode(F.array("a", "b")).alias("path")).distinct()
    known = indexed.select("path").join(ends, "path", "left_semi").distinct()
    of = lambda side: known.select(F.col("path").alias(side), F.lit(True).alias(f"k{side}"))
    g = g.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("ka", "kb", F.lit(False))).select("a", "b", "together")
    g = g.join(touched.select(F.col("path").alias("a"), F.col("n").alias("na")), "a").join(touched.select(F.col("path").alias("b"), F.col("n").alias("nb")), "b")
    return g.select("a", "b", "together", (F.col("together") / (F.col("na") + F.col("nb") - F.col("together"))).alias("strength"))


def directory(path: Column) -> Column:
    """The path up to its last slash; "." for a path without one."""
    text = path.cast("string")
    return F.when(F.contains(text, F.lit("/")), F.regexp_replace(text, "/[^/]*$", "")).otherwise(F.lit("."))


def hidden(found: DataFrame, file_edges: DataFrame, files: DataFrame, imports: DataFrame) -> DataFrame:
    """The pairs that no call edge, package or import relates, nor a common directory where
    neither file has a package (files of no symbol have none, and an empty name is none).
    files: path, package and, where paths don't tell it, dir. Of the edges, which are far more
    than the pairs, those between the files of a pair are picked first."""
    found = Scratch(found.sparkSession, "hidden").write(found, "pairs")
    ends = file_edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).join(found.select("a", "b"), ["a", "b"], "left_semi")
    place = F.col("dir") if "dir" in files.columns else directory(F.col("path"))
    of = lambda side: files.select(F.col("path").alias(side), F.nullif("package", F.lit("")).alias(f"p{side}"), place.alias(f"d{side}"))
    g = found.join(ends, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    unknown = F.col("pa").isNull() & F.col("pb").isNull() & (F.coalesce("da", directory(F.col("a"))) == F.coalesce("db", directory(F.col("b"))))
    g = g.filter(~F.coalesce(F.col("pa") == F.col("pb"), F.lit(False)) & ~unknown)
    either = imports.select(F.col("from_pkg").alias("pa"), F.col("to_pkg").alias("pb"))
    either = either.unionAll(either.select("pb", "pa")).distinct()
    return g.join(either, ["pa", "pb"], "left_anti").select("a", "b", "together", "strength")


def hidden_for(found: DataFrame, path) -> DataFrame:
    """The hidden pairs of one file, as partner, together, strength."""
    either = found.filter((F.col("a") == F.lit(path)) | (F.col("b") == F.lit(path)))
    return either.select(F.when(F.col("a") == F.lit(path), F.col("b")).otherwise(F.col("a")).alias("partner"), "together", "strength")


def top_pairs(found: DataFrame, n: int) -> DataFrame:
    """The n pairs changed together most often; ties by strength, a, b."""
    return found.orderBy(F.desc("together"), F.desc("strength"), "a", "b").limit(n)


def coupling_score(found: DataFrame) -> DataFrame:
    """path, coupling: summed strength, credited to both ends."""
    return found.select(F.explode(F.array("a", "b")).alias("path"), "strength").groupBy("path").agg(F.sum("strength").alias("coupling"))


def strongest(found: DataFrame) -> DataFrame:
    """path, partner, together: of each file the first pair by strength, a, b."""
    e = found.select(F.explode(F.array(F.struct(F.col("a").alias("path"), F.col("b").alias("partner")), F.struct(F.col("b").alias("path"), F.col("a").alias("partner")))).alias("e"), "a", "b", "together", "strength")
    w = Window.partitionBy("e.path").orderBy(F.desc("strength"), "a", "b")
    return e.withColumn("r", F.row_number().over(w)).filter("r = 1").select("e.path", "e.partner", "together")
