"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a word budget by weight (water-filling under a cap of whole repeats). A
source is taken whole as often as the budget allows; for what remains, documents are
counted by exact length, each length gives in proportion, and a bounded knapsack over the
spare counts fits the last words, as many as one or two of the longest documents have. Which
documents of a length are taken follows a seeded hash.

Edge cases: a null text has size 0 and a null source is a source of its own, ordered last;
documents of size 0 take 0 words; texts of any length are counted whole; an empty table
gives an empty result; repeated rows count as separate documents; other columns are ignored,
whatever their names. take_mix keeps them all, and leaves out documents taken 0 times.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathfold.llm.columns import column
from pathfold.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 20240601
#: Ranges of the seeded hash by which the documents of one length are ranked in parallel.
RANGES = 256


def subset_sum(lengths: list[int], spare: list[int], budget: int) -> list[int]:
    """Counts (at most spare) whose total length is as large as can be within budget.

    Bounded knapsack: the reachable totals are the bits of one integer, counts are split
    into powers of two, and each total remembers the item that reached it first.
    """
    taken = [0] * len(lengths)
    if budget <= 0:
        return taken
    mask, bits = (1 << (budget + 1)) - 1, 1
    via = np.full(budget + 1, -1, np.int32)
    items: list[tuple[int, int]] = []
    for i, (length, most) in enumerate(zip(lengths, spare, strict=True)):
        most, step = min(most, budget // length), 1
        while most > 0:
            k = min(step, most)
            new = (bits << (k * length)) & mask & ~bits
            if new:
                raw = np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8)
                via[np.flatnonzero(np.unpackbits(raw, bitorder="little")[: budget + 1])] = len(items)
                items.append((i, k))
                bits |= new
            most, step = most - k, step * 2
        if bits >> budget & 1:
            break
    total = bits.bit_length() - 1
    while total:
        i, k = items[via[total]]
        taken[i] += k
        total -= k * lengths[i]
    return taken


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words fit the budget.

    From the longest length down, documents are taken in proportion, as far as the words so
    far are due, up to a budget less by the longest length. So what remains for the knapsack
    is about one or two of the longest documents, however large the source is.
    """
    order = np.argsort(-lengths, kind="stable")
    size, n = [int(x) for x in lengths[order]], [int(x) for x in counts[order]]
    whole = sum(a * b for a, b in zip(size, n, strict=True))
    take = [b if a and budget >= whole else 0 for a, b in zip(size, n, strict=True)]
    if 0 < budget < whole:
        aim, seen, used = max(0, budget - size[0]), 0, 0
        for j, (a, b) in enumerate(zip(size, n, strict=True)):
            seen += a * b
            take[j] = min(b, (aim * seen // whole - used) // a) if a else 0
            used += take[j] * a
        left = budget - used
        fits = [j for j, a in enumerate(size) if 0 < a <= left and n[j] > take[j]]
        for j, k in zip(fits, subset_sum([size[j] for j in fits], [n[j] - take[j] for j in fits], left), strict=True):
            take[j] += k
    out = np.zeros(len(size), np.int64)
    out[order] = take
    return out


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    size, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    whole = int((size * counts).sum())
    target = float(pdf["target"].iloc[0])
    repeats = min(MOST, int(target // whole)) if whole else 0
    pdf["repeats"] = repeats
    pdf["n_more"] = fit_counts(size, counts, round(target - repeats * whole)) if repeats < MOST else 0
    return pdf[["source", "size", "n", "source_size", "target", "repeats", "n_more"]]


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target: shares by weight, none above MOST times its source.

    The level at which capping stops is the largest of the levels that result when the
    sources with the smallest cap per weight are capped first. One row per source.
    """
    w = Window.orderBy(F.col("source").isNull(), "source")
    by_cap = Window.orderBy("ratio", "pos")
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("pos", F.row_number().over(w))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("pos") - 1) % len(WEIGHTS) + 1).cast("int"))
    s = s.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * float(MOST)).withColumn("ratio", F.col("cap") / F.col("weight"))
    every = Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weights = F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("level", (SHARE * F.sum("source_size").over(every) - before) / weights)
    s = s.withColumn("level", F.max("level").over(every))
    return s.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def size_of(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(column(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sizes = scratch.write(docs.select(column(id_col).alias("doc_id"), column(source_col).alias("source"), size_of(text_col).alias("size")), "sizes")
    counts = sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")).alias("c")
    goals = targets(sizes).alias("g")
    counts = counts.join(goals, F.col("c.source").eqNullSafe(F.col("g.source"))).select("c.source", "size", "n", "source_size", "target")
    plan = counts.groupBy("source").applyInPandas(_fit_source, "source string, size long, n long, source_size long, target double, repeats int, n_more long")
    plan = scratch.write(plan, "plan").alias("p")
    key = [F.col("d.source").eqNullSafe(F.col("p.source")), F.col("d.size") == F.col("p.size")]
    rows = sizes.alias("d").join(plan, key[0] & key[1]).select("doc_id", "d.source", "d.size", "n", "source_size", "target", "repeats", "n_more")
    rows = rows.withColumn("draw", F.xxhash64(F.lit(seed), F.col("doc_id"))).withColumn("range", F.shiftrightunsigned("draw", 64 - RANGES.bit_length() + 1))
    sure = rows.filter("n_more = 0 or n_more = n").withColumn("more", F.expr("n_more > 0").cast("int"))
    some = rows.filter("n_more > 0 and n_more < n").alias("r")
    tally = some.groupBy("source", "size", "range").agg(F.count(F.lit(1)).alias("k"))
    earlier = Window.partitionBy("source", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    tally = tally.withColumn("before", F.coalesce(F.sum("k").over(earlier), F.lit(0))).alias("t")
    same = F.col("r.source").eqNullSafe(F.col("t.source")) & (F.col("r.size") == F.col("t.size")) & (F.col("r.range") == F.col("t.range"))
    some = some.join(tally, same).select("r.*", "before")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("source", "size", "range").orderBy("draw", "doc_id"))
    some = some.withColumn("more", (rank <= F.col("n_more")).cast("int")).drop("before")
    both = sure.unionByName(some).withColumn("copies", F.col("repeats") + F.col("more"))
    return both.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as the mix takes it.

    Documents that share an id, source and size are told apart by the order of a stable
    digest of their texts, so that each decision is used once.
    """
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(*(column(c).alias(to) for c, to in place.items())).withColumn("words", size_of(place[text_col]))
    decided = mix(docs, id_col, text_col, source_col).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("total"), F.count(F.lit(1)).alias("rows"))
    on = F.col(place[id_col]).eqNullSafe(F.col("doc_id")) & F.col(place[source_col]).eqNullSafe(F.col("source")) & (F.col("words") == F.col("size"))
    joined = named.join(decided, on).select(*place.values(), "words", "total", "rows")
    alone = joined.filter("rows = 1").withColumn("copies", F.col("total").cast("int"))
    among = Window.partitionBy(place[id_col], place[source_col], "words", "digest").orderBy(F.lit(1))
    shared = joined.filter("rows > 1").withColumn("digest", F.sha2(F.col(place[text_col]).cast("string"), 256))
    equal = shared.groupBy(place[id_col], place[source_col], "words", "digest").agg(F.count(F.lit(1)).alias("k"))
    earlier = Window.partitionBy(place[id_col], place[source_col], "words").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    equal = equal.withColumn("before", F.coalesce(F.sum("k").over(earlier), F.lit(0))).drop("k").alias("e")
    same = reduce(and_, (F.col(f"s.{c}").eqNullSafe(F.col(f"e.{c}")) for c in (place[id_col], place[source_col], "words", "digest")))
    shared = shared.alias("s").join(equal, same).select("s.*", "before").withColumn("nth", F.col("before") + F.row_number().over(among))
    each = F.floor(F.col("total") / F.col("rows")) + (F.col("nth") <= F.col("total") % F.col("rows")).cast("int")
    shared = shared.withColumn("copies", each.cast("int")).select(*alone.columns)
    copies = alone.unionByName(shared).withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return copies.select(*(F.col(to).alias(c) for c, to in place.items()))


QUERY = "op2_mixing"


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


SQL = None
