"""Lookups of symbols, their tests and their neighbours, and how results are grouped for display."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathfold.functions import scalar

COVERED, NAMED = 0.1, 8


def point(table: DataFrame, key: str, value, defaults: dict | None = None) -> DataFrame:
    """Exactly one row: that of the key, or the key with its defaults (or NULL)."""
    wanted = table.sparkSession.range(1).select(F.lit(value).cast(table.schema[key].dataType).alias(key))
    row = wanted.join(table.filter(F.col(key) == F.lit(value)), key, "left")
    return row.fillna(defaults) if defaults else row


def symbols_in_file(symbols: DataFrame, path) -> DataFrame:
    return symbols.filter(F.col("path") == F.lit(path)).orderBy("start", "symbol")


def covering_tests(coverage: DataFrame, symbol) -> DataFrame:
    """test, in order, of which at least a tenth runs through the symbol."""
    return coverage.filter((F.col("symbol") == F.lit(symbol)) & (F.col("fraction") >= COVERED)).select("test").distinct().orderBy("test")


def partition_by_test(found: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (node, hops) of production code, and of tests; unknown nodes are production."""
    tests = symbols.filter("is_test").select(F.col("symbol").alias("node")).distinct()
    return found.join(tests, "node", "left_anti"), found.join(tests, "node", "left_semi")


def by_hop(found: DataFrame) -> DataFrame:
    """hops, n, nodes (in order of id)."""
    return found.groupBy("hops").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("node")).alias("nodes")).orderBy("hops")


def tests_per_file(tests: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, n of the tests found (node); nodes of no known file are left out."""
    files = symbols.select(F.col("symbol").alias("node"), "path")
    return tests.join(files, "node").groupBy("path").agg(F.count_distinct("node").alias("n"))


def symbol_sizes(symbols: DataFrame) -> DataFrame:
    """item, size: the span of every symbol that is neither test nor generated."""
    return symbols.filter("NOT is_test AND NOT generated").select(F.col("symbol").alias("item"), F.col("span").cast("long").alias("size"))


def lift_to_symbols(ranked: DataFrame, symbols: DataFrame) -> DataFrame:
    """item, file_pos, nth: the readable symbols of ranked files (path, pos), in order of the
    file's place, then start and id; nth counts within the file, so no task orders them all."""
    own = symbols.filter("NOT is_test AND NOT generated").select("path", F.col("symbol").alias("item"), "start")
    nth = F.row_number().over(Window.partitionBy("path").orderBy("start", "item"))
    return own.join(ranked.select("path", F.col("pos").alias("file_pos")), "path").select("item", "file_pos", nth.alias("nth"))


def file_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """src, dst with src < dst: pairs of files that a call joins, either way."""
    of = lambda end, name: symbols.select(F.col("symbol").alias(end), F.col("path").alias(name))
    both = edges.join(of("src", "a"), "src").join(of("dst", "b"), "dst").filter("a <> b")
    return both.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def has_markers(commits: DataFrame) -> DataFrame:
    """One row: whether any commit of the whole history is marked."""
    return commits.agg(F.coalesce(F.bool_or("marked"), F.lit(False)).alias("has_markers"))


def find_symbol(symbols: DataFrame, query: str) -> DataFrame:
    """outcome, symbols: "found" with one id; "ambiguous" with the first ids; "near" with
    short ids of symbols whose names hold the query; or "none".

    The id itself comes first, then equal short ids or names, then those equal without case;
    tests only by id. One pass over the symbols: symbol, name, is_test.
    """
    short, low = scalar.short_id(F.col("symbol")), query.lower()
    s = symbols.select("symbol", "name", short.alias("short"), (~F.col("is_test")).alias("real"))
    equal = F.col("real") & ((F.col("short") == query) | (F.col("name") == query))
    folded = F.col("real") & ((F.lower("short") == low) | (F.lower("name") == low))
    near = F.col("real") & F.contains(F.lower("name"), F.lit(low))
    names = lambda c, x: F.array_sort(F.collect_set(F.when(c, F.col(x))))
    g = s.filter((F.col("symbol") == query) | equal | folded | near).agg(
        names(F.col("symbol") == query, "symbol").alias("id"), names(equal, "symbol").alias("equal"), names(folded, "symbol").alias("folded"), names(near, "short").alias("near"),
    )
    match = F.when((F.size("equal") != 1) & (F.size("folded") > 0), F.col("folded")).otherwise(F.col("equal"))
    g = g.withColumn("match", F.when(F.size("id") > 0, F.col("id")).otherwise(match))
    outcome = F.when(F.size("match") == 1, "found").when(F.size("match") > 1, "ambiguous").when(F.size("near") > 0, "near").otherwise("none")
    shown = F.when(F.size("match") > 0, F.col("match")).otherwise(F.col("near"))
    return g.select(outcome.alias("outcome"), F.slice(shown, 1, NAMED).alias("symbols"))


def resolve_names(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """id, token, item. names: name, item. A token stands for the items so called; one that is
    no name for those whose name ends in it, or that it ends in, after a dot."""
    t = tokens.select("id", scalar.normalise_token(F.col("token")).alias("token")).filter("token <> ''").distinct()
    n = names.select(scalar.normalise_token(F.col("name")).alias("name"), "item").filter("name <> ''").distinct()
    exact = t.join(n.withColumnRenamed("name", "token"), "token").select("id", "token", "item")
    rest = t.join(n.select(F.col("name").alias("token")).distinct(), "token", "left_anti")
    # every tail after a dot is a key, so the suffix match is an equality
    tails = lambda c: F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(F.split(c, "\\.")))), lambda i: F.array_join(F.slice(F.split(c, "\\."), i, F.size(F.split(c, "\\."))), "."))
    longer = n.select("item", F.explode(tails(F.col("name"))).alias("token")).filter("token <> ''")
    shorter = rest.select("id", "token", F.explode(tails(F.col("token"))).alias("name")).filter("name <> ''")
    found = rest.join(longer, "token").select("id", "token", "item").unionAll(shorter.join(n, "name").select("id", "token", "item"))
    return exact.unionAll(found).distinct()


def attribute_names(hunks: DataFrame, origins: DataFrame, symbols: DataFrame) -> DataFrame:
    """case, symbol: declarations that hunks (case, path, name) touch, found in the index by
    the path that the file had there (case, path, origin) and their local name."""
    at = hunks.filter(scalar.is_source_file(F.col("path"))).join(origins, ["case", "path"])
    return at.join(symbols.select(F.col("path").alias("origin"), F.col("local_name").alias("name"), "symbol"), ["origin", "name"]).select("case", "symbol").distinct()
