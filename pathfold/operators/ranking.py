"""Normalisation, weighted scores, tiers, order and rationale."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathfold.functions import scalar
from pathfold.operators import coupling

#: Signals in their fixed order, with weights.
WEIGHTS = {"centrality": 0.20, "churn": 0.15, "hidden_coupling": 0.25, "fix_density": 0.15, "orphaning": 0.10, "ai_density": 0.05, "task_proximity": 0.10}
TIER_ONE, TIER_TWO = 0.70, 0.40


def percentile_rank(values: DataFrame, key: str, value: str, out: str, times: str | None = None) -> DataFrame:
    """Average rank of ties over n - 1, among positive values; one value ranks 1. times: a
    column that says how many equal values a row stands for.

    Ranks come from the distinct values with their counts, so ties don't widen the window,
    and the running count is taken by ranges: first within each range of values, then over
    the ranges, so that no task orders all values.
    """
    v = values.filter((F.col(value) > 0) & ~F.isnan(F.col(value).cast("double"))).select(key, F.col(value).alias("__v"), (F.lit(1) if times is None else F.col(times)).cast("long").alias("__n"))
    tie = v.groupBy("__v").agg(F.sum("__n").alias("c"))
    part = tie.withColumn("p", F.floor(F.log2(F.col("__v").cast("double")) * 16))
    within = Window.partitionBy("p").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("low", F.coalesce(F.sum("c").over(within), F.lit(0)))
    ranges = tie.groupBy(F.floor(F.log2(F.col("__v").cast("double")) * 16).alias("p")).agg(F.sum("c").alias("k"))
    ranges = ranges.withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranges = ranges.withColumn("n", F.sum("k").over(Window.partitionBy(F.lit(1))))
    place = F.when(F.col("n") == 1, 1.0).otherwise((F.col("before") + F.col("low") + (F.col("c") - 1) / 2) / F.nullif(F.col("n") - 1, F.lit(0)))
    ranked = part.join(F.broadcast(ranges), "p").select("__v", place.alias(out))  # some thousand ranges of a double at most
    return v.join(ranked, "__v").select(key, out)


def bounded(values: DataFrame, key: str, value: str, low: float, high: float, out: str) -> DataFrame:
    """Linear between low and high, clamped; no rows where high <= low."""
    if high <= low:
        return values.limit(0).select(key, F.lit(0.0).alias(out))
    return values.select(key, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - low) / (high - low))).alias(out))


def weighted_score(symbols: DataFrame, signals: dict[str, DataFrame], weights: dict[str, float] | None = None, familiarity: DataFrame | None = None) -> DataFrame:
    """symbol, one column per active signal, score. signals: (symbol, value), normalised;
    one without rows is silent and gives no weight; only readable symbols come out."""
    weights = WEIGHTS if weights is None else weights
    active = {k: d for k, d in signals.items() if weights.get(k, 0) > 0 and not d.isEmpty()}
    out = symbols.filter("NOT is_test AND NOT generated").select("symbol").distinct()
    if not active:
        return out.limit(0).withColumn("score", F.lit(0.0))
    total = sum(weights[k] for k in active)
    for k, d in active.items():
        out = out.join(d.select("symbol", F.col("value").alias(k)), "symbol", "left")
    out = out.select("symbol", *(F.coalesce(k, F.lit(0.0)).alias(k) for k in active))
    score = sum((F.col(k) * weights[k] for k in active), F.lit(0.0)) / total
    if familiarity is not None:
        out = out.join(familiarity.select("symbol", "familiarity"), "symbol", "left")
        known = F.coalesce("familiarity", F.lit(0.0))
        score = score * (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), known)))
    return out.withColumn("score", score).drop("familiarity")


def dominant(signals: list[str], weights: dict[str, float] | None = None):
    """The signal of greatest contribution, the first on ties, NULL if all are 0."""
    weights = WEIGHTS if weights is None else weights
    parts = [F.col(k) * weights[k] for k in signals]
    best = F.greatest(*parts) if len(parts) > 1 else parts[0]
    out = F.lit(None).cast("string")
    for k, p in reversed(list(zip(signals, parts, strict=True))):
        out = F.when((p == best) & (best > 0), k).otherwise(out)
    return out


def top(scores: DataFrame, n: int) -> DataFrame:
    """Positive scores in order; n <= 0: all."""
    s = scores.filter("score > 0").orderBy(F.desc("score"), "symbol")
    return s.limit(n) if n > 0 else s


def tiers(selected: DataFrame) -> DataFrame:
    """Adds tier by the ratio to the greatest score of the selection (a short list)."""
    most = F.max("score").over(Window.partitionBy(F.lit(1)))
    ratio = F.col("score") / F.nullif(most, F.lit(0.0))
    return selected.withColumn("tier", F.when(most <= 0, 3).when(ratio >= TIER_ONE, 1).when(ratio >= TIER_TWO, 2).otherwise(3))


def sequence(tiered: DataFrame, depth: DataFrame) -> DataFrame:
    """tier, then depth, then score, then id; an unknown depth is 0."""
    return tiered.join(depth, "symbol", "left").withColumn("depth", F.coalesce("depth", F.lit(0))).orderBy("tier", "depth", F.desc("score"), "symbol")


def explain(items: DataFrame) -> DataFrame:
    """Adds rationale from evidence columns: top, partner, together, direct, within3, commits,
    fixes, orphaned_share, ai_share, hops, task, doc. Missing evidence falls through."""
    some = lambda c: F.coalesce(F.col(c), F.lit(0))
    percent = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("string")
    text = F.coalesce(
        F.when((F.col("top") == "hidden_coupling") & F.col("partner").isNotNull(), F.concat(F.lit("often changes together with "), F.col("partner").cast("string"), F.lit(" ("), F.col("together").cast("string"), F.lit(" shared commits), with no import either way"))),
        F.when((F.col("top") == "centrality") & (some("within3") > some("direct")), F.concat(scalar.plural(some("direct"), "direct caller", "direct callers"), F.lit(", "), some("within3").cast("string"), F.lit(" within 3 hops"))),
        F.when((F.col("top") == "centrality") & (some("direct") > 0), scalar.plural(some("direct"), "direct caller", "direct callers")),
        F.when((F.col("top") == "churn") & (some("commits") > 0), F.concat(F.lit("file changed in "), scalar.plural(some("commits"), "recent commit", "recent commits"))),
        F.when((F.col("top") == "fix_density") & (some("fixes") > 0), F.concat(some("fixes").cast("string"), F.lit(" of "), some("commits").cast("string"), F.lit(" recent commits were corrective"))),
        F.when((F.col("top") == "orphaning") & (F.col("orphaned_share") > 0), F.concat(percent("orphaned_share"), F.lit("% written by authors gone for 90 days"))),
        F.when((F.col("top") == "ai_density") & (F.col("ai_share") > 0), F.concat(percent("ai_share"), F.lit("% of recent lines machine-assisted"))),
        F.when((F.col("top") == "task_proximity") & (F.col("hops") == 0), F.concat(F.lit("within "), F.coalesce("task", F.lit("the named area")))),
        F.when((F.col("top") == "task_proximity") & F.col("hops").isNotNull(), F.concat(scalar.plural(F.col("hops"), "hop", "hops"), F.lit(" from "), F.coalesce("task", F.lit("the named area")))),
        F.nullif(F.col("doc"), F.lit("")),
        F.lit("high across several signals, none of them alone"),
    )
    return items.withColumn("rationale", text)


def resolve_task(symbols: DataFrame, task: str) -> DataFrame:
    """Seeds (symbol) of a task, without regard to case, outer blanks and slashes. The first
    that yields any: a symbol's id or short id (one symbol); a package, else the shortest
    whose last parts it is; a file or folder; names that hold it, unless they are more than a
    quarter of all symbols. Tests are no seeds. symbols: symbol, name, package, path, is_test.
    """
    q = task.strip().lower().replace("\\", "/").strip("/")
    if not q:
        return symbols.select("symbol").limit(0)
    s = symbols.select("symbol", "name", "package", F.lower("path").alias("path"), F.lower("package").alias("p"), (~F.col("is_test")).alias("real"))
    exact = F.col("real") & ((F.lower("symbol") == q) | (F.lower(scalar.short_id(F.col("symbol"))) == q))
    package = F.when(F.col("real") & ((F.col("p") == q) | F.col("p").endswith("/" + q)), F.struct((F.col("p") != q).alias("part"), F.length("package"), "package"))
    place = F.col("real") & ((F.col("path") == q) | F.col("path").startswith(q + "/") | (coupling.directory(F.col("path")) == q))
    named = F.col("real") & F.contains(F.lower("name"), F.lit(q))
    g = s.agg(F.min(F.when(exact, F.col("symbol"))).alias("one"), F.min(package).alias("best"), F.count_if(place).alias("placed"), F.count_if(named).alias("named"), F.count(F.lit(1)).alias("n")).first()
    if g["one"] is not None:
        return s.filter(F.col("symbol") == g["one"]).select("symbol")
    if g["best"] is not None:
        return s.filter(F.col("real") & (F.col("package") == g["best"]["package"])).select("symbol")
    if g["placed"]:
        return s.filter(place).select("symbol")
    return s.filter(named & F.lit(g["named"] <= g["n"] // 4)).select("symbol")


def centrality_signal(ranks: DataFrame, symbols: DataFrame) -> DataFrame:
    """node, value of PageRank (node, rank): known symbols that are no tests; generated ones stay."""
    return ranks.join(symbols.filter("NOT is_test").select(F.col("symbol").alias("node")).distinct(), "node", "left_semi").select("node", F.col("rank").alias("value"))


def proximity_signal(near: DataFrame, symbols: DataFrame) -> DataFrame:
    """node, value of hops from the task (node, hops), halved every two hops; tests and what
    can't be reached have none. The value is absolute and not ranked."""
    tests = symbols.filter("is_test").select(F.col("symbol").alias("node")).distinct()
    return near.join(tests, "node", "left_anti").select("node", scalar.hop_decay(F.col("hops")).alias("value"))


def quantile(values: DataFrame, value: str, q: float) -> DataFrame:
    """The value at q (n - 1), interpolated between the two beside it."""
    return values.agg(F.percentile(value, F.lit(q)).alias("quantile"))


def to_json(path: DataFrame, signals: list[str]) -> DataFrame:
    """One row with the path as JSON; numbers to 4 places, half up. path is a short list."""
    values = F.map_from_arrays(F.array(*map(F.lit, signals)), F.array(*(scalar.rounded(F.col(k)) for k in signals)))
    item = F.struct(F.col("pos"), F.col("symbol"), F.col("tier"), scalar.rounded(F.col("score")).alias("score"), values.alias("signals"))
    return path.agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("path"))).alias("json"))
