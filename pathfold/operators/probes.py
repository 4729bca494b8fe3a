"""Questions from the graph, their grading, firing rules, and user state from an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathfold.functions import scalar
from pathfold.operators import lookup
from pathfold.parts import deal
from pathfold.scratch import Scratch

FEWEST, MOST = 2, 12


def blast_questions(edges: DataFrame, coverage: DataFrame | None = None, tests: DataFrame | None = None) -> DataFrame:
    """symbol, expected: two-hop dependents and covering tests, if there are 2 to 12. Tests
    (node) are no dependents, but paths may pass through them.

    The edges to each symbol and the pairs two hops apart are counted first and dealt by symbol
    in as many partitions as that takes.
    """
    scratch = Scratch(edges.sparkSession, "blast")
    given = scratch.write(edges.select("src", "dst"), "given")
    e = deal(given, given.count(), "src").distinct().select(F.col("dst").alias("symbol"), F.col("src").alias("item"))
    plain = tests.select(F.col("node").alias("item"), F.lit(True).alias("test")).distinct() if tests is not None else None
    e = e.withColumn("test", F.lit(False)) if plain is None else e.join(plain, "item", "left").withColumn("test", F.coalesce("test", F.lit(False)))
    e = scratch.write(e.select("symbol", "item", "test"), "edges")
    one = deal(e, e.count(), "symbol")
    into = one.groupBy("symbol").agg(F.count(F.lit(1)).alias("all"), F.count_if(~F.col("test") & (F.col("symbol") != F.col("item"))).alias("n"))
    into = scratch.write(into, "into")
    # with over 12 direct dependents a symbol can't qualify, nor if one of them has over 13: all but itself are its own
    item = into.select(F.col("symbol").alias("item"), F.col("all").alias("fars"), (F.col("n") > MOST + 1).alias("wide"))
    met = scratch.write(one.join(into.filter(F.col("n") <= MOST).select("symbol"), "symbol").join(item, "item", "left").select("symbol", "item", "test", "fars", "wide"), "met")
    wide = met.filter("wide").select("symbol").distinct()
    met = met.join(wide, "symbol", "left_anti").select("symbol", "item", "test", "fars")
    met = scratch.write(met, "near")
    pairs = met.agg(F.coalesce(F.sum(1 + F.coalesce("fars", F.lit(0))), F.lit(0))).first()[0]
    two = deal(met.select("symbol", "item"), pairs, "item").join(e.select(F.col("symbol").alias("item"), F.col("item").alias("far"), "test"), "item").select("symbol", F.col("far").alias("item"), "test")
    every = met.select("symbol", "item", "test").unionAll(two).filter("NOT test").select("symbol", "item")
    if coverage is not None:
        left_out = into.filter(F.col("n") > MOST).select("symbol").unionAll(wide)
        covered = coverage.filter("fraction >= 0.1").select("symbol", F.col("test").alias("item"))
        every = every.unionAll(covered.join(left_out, "symbol", "left_anti"))
    every = deal(every.filter("item <> symbol"), pairs, "symbol").distinct()
    small = every.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(FEWEST, MOST))
    return every.join(small, "symbol").groupBy("symbol").agg(F.array_sort(F.collect_list("item")).alias("expected"))


def parse_answer(answer):
    """Tokens of an answer; NULL for a blank one or "skip"."""
    a = F.lower(F.trim(answer))
    return F.when((a == "") | (a == "skip"), None).otherwise(F.filter(F.split(answer, "[, \\t;]+"), lambda x: x != ""))


def grade_blast(answers: DataFrame, questions: DataFrame, names: DataFrame) -> DataFrame:
    """id, precision, recall, f1, outcome. answers: id, symbol, answer; names: name, item (all
    names by which an item may be called; a token that is none is tried by its last parts). A
    token that fits several expected items counts them all, so precision can exceed 1; a skip
    is neutral."""
    a = answers.select("id", "symbol", parse_answer(F.col("answer")).alias("tokens"))
    given = lookup.resolve_names(a.select("id", F.explode("tokens").alias("token")), names).join(a.select("id", "symbol"), "id")
    exp = questions.select("symbol", F.explode("expected").alias("item"))
    hit = given.join(exp, ["symbol", "item"]).groupBy("id").agg(F.count_distinct("item").alias("hits"))
    n = F.size("tokens")
    g = a.join(questions.select("symbol", F.size("expected").alias("m")), "symbol").join(hit, "id", "left")
    p, r = F.coalesce("hits", F.lit(0)) / F.nullif(n, F.lit(0)), F.coalesce("hits", F.lit(0)) / F.col("m")
    g = g.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))
    outcome = F.when(F.col("tokens").isNull(), "skipped").when(F.col("f1") >= 0.8, "correct").when(F.col("f1") >= 0.4, "partial").otherwise("incorrect")
    return g.select("id", "precision", "recall", "f1", outcome.alias("outcome"))


def choice(answer: Column, options: int | Column) -> Column:
    """The 0-based choice of an answer from 1; NULL (a skip) for a blank, "skip" or no option."""
    n = F.try_to_number(F.trim(answer), F.lit("999")).cast("int") - 1
    return F.when((n >= 0) & (n < options), n)


def grade_choice(answers: DataFrame) -> DataFrame:
    """id, outcome, score, explanation. answers: id, choice (0-based, NULL for a skip), labels,
    right (0-based) and provenance."""
    c, right = F.col("choice"), F.col("right")
    outside = (c < 0) | (c >= F.size("labels"))
    outcome = F.when(c.isNull(), "skipped").when(~outside & (c == right), "correct").otherwise("incorrect")
    text = F.when(c.isNull(), F.lit(None)).when(outside, "no option was chosen").when(c == right, F.col("provenance"))
    text = text.otherwise(F.concat(F.lit("right is "), F.get("labels", right), F.lit(": "), F.col("provenance")))
    return answers.select("id", outcome.alias("outcome"), (~outside & (c == right)).cast("double").alias("score"), F.when(c.isNotNull(), text).alias("explanation"))


def listed(items: Column, most: int = 6) -> Column:
    """The first items, and how many more there are."""
    more = F.size(items) - most
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(more > 0, F.concat(F.lit(", and "), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")))


def explain_blast(graded: DataFrame) -> DataFrame:
    """id, explanation. graded: id, expected, named (expected ones that were named), spurious
    (how many others) and provenance. The first case that holds."""
    missed = F.array_except("expected", "named")
    after = F.concat(F.lit(" ("), F.col("provenance"), F.lit(")"))
    whole = F.size(missed) == 0
    text = (
        F.when(whole & (F.col("spurious") == 0), F.concat(F.lit("all "), scalar.plural(F.size("expected"), "dependent", "dependents"), after))
        .when(whole, F.concat(F.lit("all that breaks, and "), scalar.plural(F.col("spurious"), "thing", "things"), F.lit(" that "), scalar.agrees(F.col("spurious"), "does", "do"), F.lit(" not")))
        .when(F.size("named") == 0, F.concat(F.lit("right are "), listed(F.col("expected")), after))
        .otherwise(F.concat(F.lit("not named: "), listed(missed), after))
    )
    return graded.select("id", text.alias("explanation"))


def direction_questions(static_edges: DataFrame) -> DataFrame:
    """symbol, callee: the first callee that does not call back."""
    e = static_edges.select("src", "dst").distinct()
    one_way = e.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_anti")
    return one_way.groupBy(F.col("src").alias("symbol")).agg(F.min("dst").alias("callee"))


def locate_questions(symbols: DataFrame, wrong: int = 3) -> DataFrame:
    """symbol, distractors: same package and kind first, then same package, by id. symbols:
    symbol, package, kind, doc. Packages of one short list each keep the join small."""
    s = symbols.select("symbol", "package", "kind", "doc")
    first = Window.partitionBy("package", "kind").orderBy("symbol")
    pool = s.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= wrong + 1).select(F.col("symbol").alias("other"), "package", F.col("kind").alias("k2"))
    ask = s.filter("doc IS NOT NULL AND doc <> '' AND kind NOT IN ('const', 'var')")
    both = ask.join(pool, "package").filter("symbol <> other").withColumn("far", (F.col("kind") != F.col("k2")).cast("int"))
    both = both.withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy("far", "other"))).filter(F.col("r") <= wrong)
    return both.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "other"))), lambda x: x.other).alias("distractors"))


def asked_since(log: DataFrame, since) -> DataFrame:
    return log.filter(F.col("asked_at") >= since).orderBy("asked_at", "symbol")


def allowed(log: DataFrame, now, daily: int = 3, requested: bool = False) -> bool:
    """Whether a question may be asked: on request always, else if fewer than `daily` were
    asked within 24 hours, skips included."""
    return requested or log.filter(F.col("asked_at") >= now - F.expr("INTERVAL 24 HOURS")).limit(daily).count() < daily


def eligible(log: DataFrame, candidates: DataFrame, now, cooldown: Column | None = None) -> DataFrame:
    """Candidates (symbol, is_test) that are no tests and were not asked within the cooldown,
    an interval (7 days unless stated)."""
    since = now - (F.expr("INTERVAL 7 DAYS") if cooldown is None else cooldown)
    cool = log.filter(F.col("asked_at") >= since).select("symbol").distinct()
    return candidates.filter("NOT is_test").join(cool, "symbol", "left_anti")


def may_fire(log: DataFrame, candidates: DataFrame, now, daily: int = 3, cooldown: Column | None = None) -> DataFrame:
    """The eligible candidates; none once `daily` questions were asked within 24 hours."""
    out = eligible(log, candidates, now, cooldown)
    return out if allowed(log, now, daily) else out.limit(0)


def first_edits(edits: DataFrame, counters: DataFrame, log: DataFrame, now, daily: int = 3) -> DataFrame:
    """The edited symbols that the user has not met before (no counter), if one may ask."""
    new = edits.select("symbol").distinct().join(counters.select("symbol"), "symbol", "left_anti")
    return new if allowed(log, now, daily) else new.limit(0)


def next_question(candidates: DataFrame, *questions: tuple[str, DataFrame]) -> DataFrame:
    """symbol, kind of the first candidate (symbol, pos) for which a kind has a question; the
    kinds are tried in the order given."""
    every = None
    for k, (kind, found) in enumerate(questions):
        one = found.select("symbol").distinct().select("symbol", F.lit(k).alias("k"), F.lit(kind).alias("kind"))
        every = one if every is None else every.unionAll(one)
    return candidates.select("symbol", "pos").join(every, "symbol").orderBy("pos", "symbol", "k").limit(1).select("symbol", "kind")


def health(log: DataFrame) -> DataFrame:
    """asked, answered, skipped, median, broken: the upper median of positive answer times."""
    skip = F.col("outcome") == "skipped"
    n = log.filter(~skip & (F.col("elapsed_ms") > 0))
    counted = n.groupBy("elapsed_ms").agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy("elapsed_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = counted.withColumn("to", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(F.lit(1)))).filter("to > n div 2").agg(F.min("elapsed_ms").alias("median"))
    g = log.agg(F.count(F.lit(1)).alias("asked"), F.count_if(~skip).alias("answered"), F.count_if(skip).alias("skipped")).crossJoin(F.broadcast(middle))  # one row each
    rate = F.col("skipped") / F.nullif("asked", F.lit(0))
    return g.withColumn("broken", (F.coalesce("median", F.lit(0)) > 30000) | ((F.col("asked") >= 5) & (rate > 0.6)))


def engagement(events: DataFrame) -> DataFrame:
    """symbol, edits, seen, correct, skipped, first_seen, last_seen from the event log."""
    kind, outcome = F.col("kind"), F.col("outcome")
    answered = (kind == "probe") & (outcome != "skipped")
    return events.groupBy("symbol").agg(
        F.count_if(kind == "edit").alias("edits"), F.count_if(answered).alias("seen"), F.count_if(answered & (outcome == "correct")).alias("correct"),
        F.count_if((kind == "probe") & (outcome == "skipped")).alias("skipped"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"),
    )
