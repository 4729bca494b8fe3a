"""Connected components of an edge table by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathfold.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """v, label for every end of an edge (a, b); label is the least vertex of the component.

    Each round every vertex takes the least label around it, then the label of its label.
    Rounds are logarithmic for stars and chains of stars. Labels are a table in the shared
    folder after each round; nothing is collected but the number of changes.
    """
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionAll(edges.select(F.col("b").alias("v"), F.col("a").alias("u"))).distinct()
    both = scratch.write(both, f"{name}-edges")
    labels = scratch.write(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("v").alias("u"), F.col("label").alias("l")), "u").groupBy("v").agg(F.min("l").alias("l"))
        low = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "l").alias("low"))
        jump = labels.select(F.col("v").alias("low"), F.col("label").alias("next"))
        moved = low.join(jump, "low").select("v", "old", F.least("low", "next").alias("label"))
        moved = scratch.write(moved, f"{name}-{step}")
        if moved.filter("label <> old").isEmpty():
            return moved.select("v", "label")
        scratch.drop(f"{name}-{step - 1}")
        labels = moved.select("v", "label")
