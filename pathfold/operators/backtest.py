"""Backtest: cases from history, rank metrics, strata, matched pairs, summary and verdict."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathfold.scratch import Scratch

K, STRATA, RATIO, LEAST_PAIRS = 10, 4, 1.25, 5
#: A spread of sizes up to which a band holds size still; gaps that count for nothing, and for much.
TIGHT, NEGLIGIBLE, DECISIVE = 4.0, 0.015, 0.045


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Adds the place from 1 in a total order: rows are sorted by range, counted by range, and
    each range is numbered from its count on, so that no task orders all rows.

    The sorted rows are a table first, since a range sort samples anew when it is repeated.
    """
    sorted_rows = rows.orderBy(*order).withColumn("range_of_row", F.spark_partition_id()).withColumn("row_in_table", F.monotonically_increasing_id())
    table = Scratch(rows.sparkSession, "numbered").write(sorted_rows, "rows")
    counts = table.groupBy("range_of_row").agg(F.count(F.lit(1)).alias("n"), F.min("row_in_table").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range_of_row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("range_of_row", (before - F.col("first") + 1).alias("shift"))
    return table.join(F.broadcast(starts), "range_of_row").withColumn(name, F.col("row_in_table") + F.col("shift")).drop("range_of_row", "row_in_table", "shift")


def commit_order(commits: DataFrame) -> DataFrame:
    """Adds pos, the 0-based place by (ts, hash). Days are ordered first by their counts, then
    the commits of each day, so that no task orders the whole history."""
    day = F.to_date("ts")
    c = commits.withColumn("day", day)
    days = c.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    days = days.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    c = c.join(days.select("day", "before"), "day")
    return c.withColumn("pos", F.col("before") + F.row_number().over(Window.partitionBy("day").orderBy("ts", "hash")) - 1).drop("day", "before")


def find_cases(commits: DataFrame, files: DataFrame, horizon: int = 90, least_files: int = 3, least_prior: int = 100, most: int = 0) -> DataFrame:
    """author, first_seen, first_pos, n_files: newcomers after least_prior commits, with the
    distinct files of their first horizon days (inclusive) that existed before they came."""
    c = commit_order(commits)
    first = c.groupBy("author").agg(F.min(F.struct("pos", "ts")).alias("f")).select("author", F.col("f.pos").alias("first_pos"), F.col("f.ts").alias("first_seen"))
    first = first.filter(F.col("first_pos") >= least_prior)
    born = files.join(c.select("hash", "pos"), "hash").groupBy("path").agg(F.min("pos").alias("born"))
    own = c.join(first, "author").filter(F.col("ts") <= F.col("first_seen") + F.expr(f"INTERVAL {horizon} DAYS"))
    touched = own.join(files.select("hash", "path"), "hash").select("author", "first_seen", "first_pos", "path").distinct()
    existing = touched.join(born, "path").filter(F.col("born") < F.col("first_pos"))
    cases = existing.groupBy("author", "first_seen", "first_pos").agg(F.count(F.lit(1)).alias("n_files")).filter(F.col("n_files") >= least_files)
    return cases.orderBy(F.desc("n_files"), "author").limit(most) if most else cases


def metrics(predicted: DataFrame, actual: DataFrame, k: int = K) -> DataFrame:
    """case, strategy, precision, recall, rr, f1. predicted: case, strategy, item, pos (from
    1); actual: case, item. Precision divides by what was predicted, at most k."""
    truth = actual.select("case", "item").distinct()
    hits = predicted.join(truth, ["case", "item"]).groupBy("case", "strategy").agg(F.count_if(F.col("pos") <= k).alias("hits"), F.min("pos").alias("first"))
    shown = predicted.groupBy("case", "strategy").agg(F.count_if(F.col("pos") <= k).alias("shown"))
    size = truth.groupBy("case").agg(F.count(F.lit(1)).alias("n"))
    return _rates(shown.join(size, "case").join(hits, ["case", "strategy"], "left"))


def metrics_of_one(ranked: DataFrame, actual: DataFrame, strategy: str, k: int = K) -> DataFrame:
    """metrics() of one ranking (item, pos) that serves all cases, not repeated for each."""
    truth = actual.select("case", "item").distinct()
    shown = F.broadcast(ranked.agg(F.count_if(F.col("pos") <= k).alias("shown")))  # one row
    g = truth.join(ranked.select("item", "pos"), "item", "left").groupBy("case").agg(F.count_if(F.col("pos") <= k).alias("hits"), F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    return _rates(g.crossJoin(shown).withColumn("strategy", F.lit(strategy)))


def _rates(g: DataFrame) -> DataFrame:
    hits = F.coalesce("hits", F.lit(0))
    p, r = F.coalesce(hits / F.nullif("shown", F.lit(0)), F.lit(0.0)), hits / F.col("n")
    g = g.select("case", "strategy", p.alias("precision"), r.alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))
    return g.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


def rank_files(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds pos: value descending, path ascending, positive values only, within `by`."""
    live = scores.filter("value > 0")
    if not by:
        return numbered(live, [F.desc("value"), F.col("path")], "pos")
    return live.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), "path")))


def size_bands(sizes: DataFrame, bands: int = STRATA) -> DataFrame:
    """Adds band: place by (size, item) times bands over n, rounded down (not ntile)."""
    s = numbered(sizes, [F.col("size"), F.col("item")], "i")
    n = F.broadcast(sizes.agg(F.count(F.lit(1)).alias("n_all")))  # one row
    return s.crossJoin(n).withColumn("band", F.expr(f"(i - 1) * {bands} div n_all").cast("int")).drop("i", "n_all")


def stratified_precision(predicted: DataFrame, actual: DataFrame, banded: DataFrame, k: int = K) -> DataFrame:
    """case, strategy, band, precision, spread: of each band its first kq predictions, where
    kq is half the band, at most k; bands under 3 or without truth are left out."""
    size = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("hi"), F.min("size").alias("lo"))
    size = size.withColumn("kq", F.least(F.lit(k), F.expr("n div 2"))).filter("kq >= 3")
    truth = actual.select("case", "item").distinct().join(banded.select("item", "band"), "item")
    live = truth.select("case", "band").distinct()
    p = predicted.join(banded.select("item", "band"), "item").join(live, ["case", "band"], "left_semi").join(size, "band")
    p = p.withColumn("r", F.row_number().over(Window.partitionBy("case", "strategy", "band").orderBy("pos"))).filter("r <= kq")
    p = p.join(truth.withColumn("hit", F.lit(1)), ["case", "item", "band"], "left")
    g = p.groupBy("case", "strategy", "band", "kq", "hi", "lo").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("hits"))
    return g.select("case", "strategy", "band", (F.col("hits") / F.col("kq")).alias("precision"), (F.col("hi") / F.nullif("lo", F.lit(0))).alias("spread"))


def fnv1a_64(text: str) -> int:
    h = 14695981039346656037
    for b in text.encode():
        h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return h


def _pair_case(pdf: pd.DataFrame) -> pd.DataFrame:
    """Greedy by nature: each truth item in id order takes the nearest unused other item. Items
    of one size are a run; runs that are used up are skipped by path-compressed pointers."""
    pdf = pdf.sort_values(["size", "item"], kind="stable")
    other = pdf[~pdf["truth"]]
    sizes, first = np.unique(other["size"].to_numpy(), return_index=True)
    ids = np.split(other["item"].astype(str).to_numpy(), first[1:]) if len(sizes) else []
    runs = [sorted(r) for r in ids]
    up, down = list(range(len(runs) + 1)), list(range(len(runs) + 1))  # down is shifted by 1

    def seek(link: list[int], i: int) -> int:
        while link[i] != i:
            link[i] = link[link[i]]
            i = link[i]
        return i

    rows = []
    for item, size in pdf[pdf["truth"]].sort_values("item")[["item", "size"]].itertuples(index=False):
        if size <= 0:
            continue
        at = int(np.searchsorted(sizes, size))
        above, below = seek(up, at), seek(down, at) - 1
        gaps = [abs(sizes[j] - size) for j in (above, below) if 0 <= j < len(runs)]
        if not gaps:
            continue
        near = sorted({j for j in (above, below) if 0 <= j < len(runs) and abs(sizes[j] - size) == min(gaps)})
        tied = sorted((x, j) for j in near for x in runs[j]) if len(near) > 1 else None
        k = fnv1a_64(str(item)) % (len(tied) if tied else len(runs[near[0]]))
        twin, j = tied[k] if tied else (runs[near[0]][k], near[0])
        if sizes[j] > 0 and max(size, sizes[j]) / min(size, sizes[j]) <= RATIO:
            runs[j].remove(twin)
            if not runs[j]:
                up[j], down[j + 1] = j + 1, j
            rows.append((pdf["case"].iloc[0], str(item), twin))
    return pd.DataFrame(rows, columns=["case", "item", "twin"])


def matched_pairs(candidates: DataFrame) -> DataFrame:
    """case, item, twin. candidates: case, item, size, truth; a case is one repository."""
    kind = candidates.schema["case"].dataType.simpleString()
    return candidates.groupBy("case").applyInPandas(_pair_case, f"case {kind}, item string, twin string")


def matched_score(pairs: DataFrame, predicted: DataFrame) -> DataFrame:
    """case, strategy, pairs, matched: a win counts 1, equal places 0.5; unranked items come
    after all others; cases with under LEAST_PAIRS pairs are left out."""
    most = predicted.groupBy("case", "strategy").agg(F.max("pos").alias("last"))
    p = pairs.join(most, "case")
    at = lambda key, name: predicted.select("case", "strategy", F.col("item").cast("string").alias(key), F.col("pos").alias(name))
    p = p.join(at("item", "pi"), ["case", "strategy", "item"], "left").join(at("twin", "pt"), ["case", "strategy", "twin"], "left")
    i, t = F.coalesce("pi", F.col("last") + 1), F.coalesce("pt", F.col("last") + 1)
    g = p.groupBy("case", "strategy").agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.when(i < t, 1.0).when(i == t, 0.5).otherwise(0.0)).alias("matched"))
    return g.filter(F.col("pairs") >= LEAST_PAIRS)


def summarise(scores: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """strategy, cases, precision, recall, mrr, median and, given the matched scores of cases,
    matched: unweighted over cases."""
    if matched is not None:
        means = matched.groupBy("strategy").agg(F.avg("matched").alias("matched"), F.count(F.lit(1)).alias("matched_cases"), F.sum("pairs").alias("matched_pairs"))
        return summarise(scores).join(means, "strategy", "left")
    return scores.groupBy("strategy").agg(F.count(F.lit(1)).alias("cases"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"), F.percentile("precision", F.lit(0.5)).alias("median"))


def verdict(summary: DataFrame, candidate: str, baselines: list[str], controls: list[str] = ()) -> DataFrame:
    """passed (strictly above every baseline; a tie is a loss), beaten, lost, outscored, hollow.
    Controls only flag."""
    own = summary.filter(F.col("strategy") == candidate).select(F.col("precision").alias("own"))
    s = summary.crossJoin(F.broadcast(own))  # one row
    base, control = F.col("strategy").isin(*baselines), F.col("strategy").isin(*controls) if controls else F.lit(False)
    named = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("strategy"))))
    g = s.agg(named(base & (F.col("own") > F.col("precision"))).alias("beaten"), named(base & (F.col("own") <= F.col("precision"))).alias("lost"), named(control & (F.col("precision") > F.col("own"))).alias("outscored"))
    passed = (F.size("lost") == 0) & (F.size("beaten") == len(baselines))
    return g.select(passed.alias("passed"), "beaten", "lost", "outscored", (passed & (F.size("outscored") > 0)).alias("hollow"))


def coupling_lift(newcomer: DataFrame, least_fixes: int = 15, least_hits: int = 5) -> DataFrame:
    """commits, fixes, fixes_on, base, fix_rate, lift, verdict. newcomer: corrective, coupled
    per commit."""
    g = newcomer.agg(F.count(F.lit(1)).alias("commits"), F.count_if("coupled").alias("on"), F.count_if("corrective").alias("fixes"), F.count_if(F.col("corrective") & F.col("coupled")).alias("fixes_on"))
    base, rate = F.col("on") / F.nullif("commits", F.lit(0)), F.col("fixes_on") / F.nullif("fixes", F.lit(0))
    g = g.withColumn("base", base).withColumn("fix_rate", rate).withColumn("lift", F.col("fix_rate") / F.nullif("base", F.lit(0.0)))
    return g.withColumn("verdict", lift_verdict(least_fixes, least_hits))


def lift_verdict(least_fixes: int = 15, least_hits: int = 5) -> Column:
    """The first rule that holds, of columns fixes, fixes_on, base and lift."""
    lift = F.col("lift")
    return (
        F.when(F.col("fixes") < least_fixes, "too few fixes").when(F.col("fixes_on") < least_hits, "too few hits").when(F.coalesce("base", F.lit(0.0)) == 0, "never touched")
        .when(lift >= 1.5, "strong").when(lift > 1.1, "modest").when(lift >= 0.9, "none").otherwise("opposite")
    )


def pooled_lift(lifts: DataFrame, least_fixes: int = 15, least_hits: int = 5) -> DataFrame:
    """fixes, fixes_on, base, fix_rate, lift, verdict over repositories (fixes, fixes_on,
    base). The base rate is weighted by fixes; repositories without one don't count for it."""
    live = (F.col("base") > 0) & (F.col("fixes") > 0)
    g = lifts.agg(F.sum("fixes").alias("fixes"), F.sum("fixes_on").alias("fixes_on"), F.sum(F.when(live, F.col("base") * F.col("fixes"))).alias("on"), F.sum(F.when(live, F.col("fixes"))).alias("of"))
    g = g.withColumn("base", F.coalesce(F.col("on") / F.nullif("of", F.lit(0)), F.lit(0.0))).withColumn("fix_rate", F.coalesce(F.col("fixes_on") / F.nullif("fixes", F.lit(0)), F.lit(0.0)))
    g = g.withColumn("lift", F.coalesce(F.col("fix_rate") / F.nullif("base", F.lit(0.0)), F.lit(0.0)))
    return g.withColumn("verdict", lift_verdict(least_fixes, least_hits)).drop("on", "of")


def read_strata(overall: DataFrame, bands: DataFrame, candidate: str, incumbent: str) -> DataFrame:
    """One row: n, wins, tight, tight_gap, mean_gap, reading. overall: strategy, precision;
    bands: strategy, band, precision, cases, spread (of sizes within the band).

    A band counts where both strategies have it; it is won strictly, and tight if its spread
    is over 0 and at most TIGHT. The reading is the first rule that holds.
    """
    of = lambda name, *new: bands.filter(F.col("strategy") == name).select("band", F.col("precision").alias(new[0]), *new[1:])
    both = of(candidate, "p", "spread").join(of(incumbent, "q"), "band")
    gap, tight = F.col("p") - F.col("q"), (F.col("spread") > 0) & (F.col("spread") <= TIGHT)
    g = both.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(gap > 0).alias("wins"), F.count_if(tight).alias("tight"),
        F.coalesce(F.avg(F.when(tight, gap)), F.lit(0.0)).alias("tight_gap"), F.coalesce(F.avg(gap), F.lit(0.0)).alias("mean_gap"),
    )
    at = lambda name: F.coalesce(F.max(F.when(F.col("strategy") == name, F.col("precision"))), F.lit(0.0))
    g = g.crossJoin(F.broadcast(overall.agg(at(candidate).alias("own"), at(incumbent).alias("other"))))  # one row each
    none = F.col("wins") == 0
    reading = (
        F.when(F.col("n") == 0, "no band could be scored").when(F.col("own") > F.col("other"), "leads overall").when(F.col("wins") == F.col("n"), "trails overall, wins every band")
        .when(none & (F.col("tight") > 0) & (-F.col("tight_gap") < NEGLIGIBLE), "adds nothing over size").when(none, "trails in every band")
        .when(F.col("mean_gap") <= -DECISIVE, "trails by the margin").otherwise("mixed")
    )
    return g.select("n", "wins", "tight", "tight_gap", "mean_gap", reading.alias("reading"))


def contributions(summary: DataFrame, variants: DataFrame, candidate: str) -> DataFrame:
    """signal, precision_gain, matched_gain, harmful. summary: strategy, precision, matched;
    variants: signal and the strategy that leaves it out. A signal is harmful if precision is
    higher without it."""
    own = F.broadcast(summary.filter(F.col("strategy") == candidate).select(F.col("precision").alias("p"), F.col("matched").alias("m")))  # one row
    g = variants.join(summary, "strategy").crossJoin(own)
    return g.select("signal", (F.col("p") - F.col("precision")).alias("precision_gain"), (F.col("m") - F.col("matched")).alias("matched_gain"), (F.col("precision") > F.col("p")).alias("harmful"))


def ablation_weights(weights: dict[str, float], kept: tuple[str, ...] = ("task_proximity",)) -> dict[str, dict[str, float]]:
    """The weights of each variant: all of them under "", and one variant a signal without it."""
    return {"": dict(weights)} | {s: weights | {s: 0.0} for s in weights if s not in kept}


def fingerprint(cases: DataFrame) -> DataFrame:
    """The first 12 hex digits of SHA-256 over the sorted case names, each ended by NUL."""
    joined = F.concat(F.array_join(F.array_sort(F.collect_list("name")), "\0"), F.lit("\0"))
    return cases.agg(F.substring(F.sha2(F.when(F.count(F.lit(1)) > 0, joined).otherwise(""), 256), 1, 12).alias("case_set"))


def proportional_draw(sizes: DataFrame, seed: int = 1) -> DataFrame:
    """Adds pos of a size-weighted draw without replacement: order by -ln(u) / size."""
    u = (F.shiftrightunsigned(F.xxhash64("item", F.lit(seed)), 11) + 1) / float(1 << 53)
    s = sizes.filter("size > 0").withColumn("key", -F.ln(u) / F.col("size"))
    return numbered(s, [F.col("key"), F.col("item")], "pos").drop("key")
