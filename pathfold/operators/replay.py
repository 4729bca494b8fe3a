"""The state of paths at a place of the history: which exist, and what they were called."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def files_as_of(changes: DataFrame, before: int | None = None) -> DataFrame:
    """path of every file that exists after the changes (pos, path, renamed) before a place.

    A rename takes the old name away, then its path stands; the last event of a name wins.
    Deletions leave no trace in a numstat log, so a deleted file stays.
    """
    c = changes if before is None else changes.filter(F.col("pos") < before)
    gone = c.filter("renamed IS NOT NULL").select(F.col("renamed").alias("name"), "pos", F.col("path").alias("by"), F.lit(0).alias("there"))
    made = c.select(F.col("path").alias("name"), "pos", F.col("path").alias("by"), F.lit(1).alias("there"))
    last = gone.unionAll(made).groupBy("name").agg(F.max(F.struct("pos", "by", "there")).alias("e"))
    return last.filter("e.there = 1").select(F.col("name").alias("path"))


def _follow(existing: pd.DataFrame, renames: pd.DataFrame) -> pd.DataFrame:
    if not len(existing):
        return existing.assign(origin=existing["path"])
    now = dict(zip(existing["path"], existing["path"], strict=True))
    for old, new in renames.sort_values(["pos", "new"], kind="stable")[["old", "new"]].itertuples(index=False):
        if old in now:
            now[new] = now.pop(old)
    return pd.DataFrame({"case": [existing["case"].iloc[0]] * len(now), "path": list(now), "origin": list(now.values())})


def origins(existing: DataFrame, renames: DataFrame) -> DataFrame:
    """case, path, origin: what each file of a case (case, path) that existed at its start is
    called after the renames (case, pos, old, new), in order; a name taken over is lost. Each
    rename depends on those before, so a case, which is one repository, is one task."""
    kind = lambda c: existing.schema[c].dataType.simpleString()
    return existing.groupBy("case").cogroup(renames.groupBy("case")).applyInPandas(_follow, f"case {kind('case')}, path {kind('path')}, origin {kind('path')}")


def targets(touched: DataFrame, kind: str, least: int | None = None) -> DataFrame:
    """case, item of the cases that have enough. touched: case, item, corrective.

    kind: "touched", "corrected", "symbols" or "corrected symbols"; of symbols at least 3 are
    asked for, of corrected files 2, of touched files 1.
    """
    least = least or {"touched": 1, "corrected": 2}.get(kind, 3)
    t = touched.filter("corrective") if kind.startswith("corrected") else touched
    t = t.select("case", "item").distinct()
    enough = t.groupBy("case").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return t.join(enough.select("case"), "case", "left_semi")
