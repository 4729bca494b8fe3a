"""Queries over the bound tables, each with equivalent DuckDB SQL where SQL can express it.

Results are rounded to 6 places at the output edge, since sums depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathfold.functions import scalar
from pathfold.operators import backtest, coupling, graph, history, probes, ranking
from pathfold.scratch import Scratch
from pathfold.sources.binding import View

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WINDOW_DAYS = 365

#: Common table expressions of the binding, for the oracles.
BASE = """
WITH RECURSIVE nowt AS (SELECT max(o_orderdate) AS now FROM orders),
commits AS (SELECT o_orderkey AS hash, o_custkey AS author, o_orderdate AS ts, o_orderpriority IN ('1-URGENT', '2-HIGH') AS corrective, o_orderstatus = 'P' AS marked FROM orders),
commit_files AS (SELECT l_orderkey AS hash, l_partkey AS path, CAST(sum(l_quantity) AS BIGINT) AS added FROM lineitem GROUP BY ALL),
files AS (SELECT p_partkey AS path, p_brand AS package, p_type AS dir, p_size AS span, p_type = 'PROMO' AS is_test, p_type = 'ECONOMY' AS generated FROM part),
symbols AS (SELECT DISTINCT l_partkey * 1000000 + l_suppkey AS symbol, f.* FROM lineitem JOIN files f ON l_partkey = path),
sites AS (SELECT l_orderkey AS hash, l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem),
call_sites AS (SELECT src, dst, o_orderstatus = 'F' AS static FROM sites JOIN orders ON o_orderkey = hash WHERE dst IS NOT NULL AND src <> dst),
edges AS (SELECT DISTINCT src, dst FROM call_sites),
brands AS (SELECT DISTINCT package, CAST(regexp_extract(package, '#([0-9]+)', 1) AS INT) AS k FROM files),
imports AS (SELECT a.package AS from_pkg, b.package AS to_pkg FROM brands a JOIN brands b ON b.k = a.k + 1),
authorship AS (SELECT path, author, lines, last_active FROM (SELECT path, author, sum(added) AS lines FROM commit_files JOIN commits USING (hash) GROUP BY ALL)
  JOIN (SELECT author, max(ts) AS last_active FROM commits GROUP BY ALL) USING (author)),
changes AS (SELECT c.*, path, added, now FROM commits c JOIN commit_files USING (hash), nowt WHERE ts >= now - INTERVAL 365 DAY),
churn AS (SELECT path, sum(pow(2.0, -greatest(0.0, epoch(now - ts) / 3600.0) / 4368.0)) AS churn FROM changes GROUP BY path)
"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = BASE + sql
        return f

    return add


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _changes(v: View) -> DataFrame:
    return v.windowed(WINDOW_DAYS).join(v.commit_files, "hash")


@query("churn", "SELECT path, round(churn, 6) AS churn FROM churn")
def churn(spark, d):
    return _round(history.churn(_changes(View(spark, d))), "churn")


TIES = """SELECT path, round(CASE WHEN n = 1 THEN 1.0 ELSE (r + (c - 1) / 2.0) / (n - 1) END, 6) AS value FROM (
  SELECT path, k, rank() OVER (ORDER BY k) - 1 AS r, count(*) OVER (PARTITION BY k) AS c, count(*) OVER () AS n FROM (SELECT path, count(*) AS k FROM changes GROUP BY path))"""


@query("normalize", TIES)
def normalize(spark, d):
    counts = history.most_churned(_changes(View(spark, d)))
    return _round(ranking.percentile_rank(counts, "path", "value", "rank"), "rank").withColumnRenamed("rank", "value")


@query("top_k", "SELECT path, round(churn, 6) AS churn FROM churn ORDER BY round(churn, 6) DESC, path LIMIT 10")
def top_k(spark, d):
    return _round(history.churn(_changes(View(spark, d))), "churn").orderBy(F.desc("churn"), "path").limit(10)


@query("bounded_normalize", "SELECT path, round(least(1.0, greatest(0.0, (churn - 0.5) / 2.5)), 6) AS value FROM churn")
def bounded_normalize(spark, d):
    return _round(ranking.bounded(history.churn(_changes(View(spark, d))), "path", "churn", 0.5, 3.0, "value"), "value")


@query("fix_density", "SELECT path, round(f / n * ln(1 + f), 6) AS fix_density FROM (SELECT path, sum(corrective::INT)::DOUBLE AS f, count(*) AS n FROM changes GROUP BY path) WHERE f > 0")
def fix_density(spark, d):
    return _round(history.fix_density(_changes(View(spark, d))), "fix_density")


@query(
    "orphaning",
    """SELECT path, round(o / t, 6) AS orphaned_share, round(CASE WHEN o > 0 THEN o / t * ln(1 + o) END, 6) AS orphaning FROM (
  SELECT path, sum(CASE WHEN coalesce(last_active < now - INTERVAL 90 DAY, true) THEN lines ELSE 0 END)::DOUBLE AS o, sum(lines) AS t FROM authorship, nowt GROUP BY path) WHERE t > 0""",
)
def orphaning(spark, d):
    v = View(spark, d)
    return _round(history.orphaning(v.authorship, v.now), "orphaned_share", "orphaning")


@query("ai_density", "SELECT path, round(a / t * ln(1 + a), 6) AS ai_density FROM (SELECT path, sum(CASE WHEN marked THEN added ELSE 0 END)::DOUBLE AS a, sum(added) AS t FROM changes GROUP BY path) WHERE a > 0 AND t > 0")
def ai_density(spark, d):
    return _round(history.ai_density(_changes(View(spark, d))), "ai_density")


@query("authorship", "SELECT path, author, CAST(lines AS BIGINT) AS lines, last_active FROM authorship")
def authorship(spark, d):
    return View(spark, d).authorship


def _baseline(name: str, sql: str, f: Callable[[View], DataFrame]) -> None:
    """The first 50 files, and as baseline_<name>_all the whole ranking."""
    indexed = "WHERE value > 0 AND path IN (SELECT path FROM symbols WHERE NOT is_test)"
    ranked = f"SELECT path, CAST(value AS DOUBLE) AS value, row_number() OVER (ORDER BY value DESC, path) AS pos FROM ({sql}) {indexed}"
    rank = lambda spark, d: backtest.rank_files(history.only_indexed(f(v := View(spark, d)), v.symbols))
    query(f"baseline_{name}", f"{ranked} QUALIFY pos <= 50")(lambda spark, d: rank(spark, d).filter("pos <= 50"))
    query(f"baseline_{name}_all", ranked)(rank)


_baseline("churned", "SELECT path, count(*) AS value FROM changes GROUP BY path", lambda v: history.most_churned(_changes(v)))
_baseline("recent", "SELECT path, epoch(max(ts)) AS value FROM commits JOIN commit_files USING (hash) GROUP BY path", lambda v: history.most_recent(v.commits.join(v.commit_files, "hash")))
_baseline("authors", "SELECT path, count(DISTINCT author) AS value FROM changes GROUP BY path", lambda v: history.most_authors(_changes(v)))
_baseline("largest", "SELECT path, sum(span) AS value FROM symbols WHERE NOT is_test GROUP BY path", lambda v: history.largest_files(v.symbols))

for _how, _sql in (("max", "max"), ("mean", "avg"), ("sum", "sum")):
    query(f"collapse_{_how}", f"SELECT package AS path, round({_sql}(churn), 6) AS value FROM churn JOIN files USING (path) WHERE churn > 0 GROUP BY package")(
        lambda spark, d, how=_how: _round(history.collapse(history.churn(_changes(v := View(spark, d))).join(v.files, "path").select(F.col("package").alias("path"), F.col("churn").alias("score")), how), "value")
    )

PAIRS = """, touched AS (SELECT path, count(*) AS n FROM commit_files GROUP BY path),
small AS (SELECT hash FROM commit_files GROUP BY hash HAVING count(*) BETWEEN 2 AND {most}),
indexed AS (SELECT DISTINCT path FROM symbols WHERE NOT is_test),
grouped AS (SELECT x.path AS a, y.path AS b, count(*) AS together FROM commit_files x JOIN commit_files y ON x.hash = y.hash AND x.path < y.path
  WHERE x.hash IN (SELECT hash FROM small) AND (x.path IN (SELECT path FROM indexed) OR y.path IN (SELECT path FROM indexed)) GROUP BY ALL HAVING count(*) >= 2),
pairs AS (SELECT a, b, together, together / (ta.n + tb.n - together)::DOUBLE AS strength FROM grouped JOIN touched ta ON ta.path = a JOIN touched tb ON tb.path = b),
hidden AS (SELECT p.* FROM pairs p JOIN files fa ON fa.path = a JOIN files fb ON fb.path = b WHERE fa.package <> fb.package
  AND NOT EXISTS (SELECT 1 FROM edges e WHERE (e.src = a AND e.dst = b) OR (e.src = b AND e.dst = a))
  AND NOT EXISTS (SELECT 1 FROM imports i WHERE (from_pkg = fa.package AND to_pkg = fb.package) OR (from_pkg = fb.package AND to_pkg = fa.package)))
"""


def _pairs(v: View, most: int = 20) -> DataFrame:
    return coupling.pairs(v.commit_files, v.symbols.filter("NOT is_test"), most, 2, rows=v.lines)


def _hidden(v: View, edges: DataFrame | None = None) -> DataFrame:
    return coupling.hidden(_pairs(v), v.call_sites if edges is None else edges, v.files, v.imports)


@query("cochange_pairs", PAIRS.format(most=20) + "SELECT a, b, together, round(strength, 6) AS strength FROM pairs")
def cochange_pairs(spark, d):
    return _round(_pairs(View(spark, d)), "strength")


@query("cochange_capped", PAIRS.format(most=6) + "SELECT a, b, together, round(strength, 6) AS strength FROM pairs")
def cochange_capped(spark, d):
    return _round(_pairs(View(spark, d), 6), "strength")


@query("hidden_pairs", PAIRS.format(most=20) + "SELECT a, b, together, round(strength, 6) AS strength FROM hidden")
def hidden_pairs(spark, d):
    return _round(_hidden(View(spark, d)), "strength")


@query("hidden_coupling", PAIRS.format(most=20) + "SELECT path, round(sum(strength), 6) AS coupling FROM (SELECT a AS path, strength FROM hidden UNION ALL SELECT b, strength FROM hidden) GROUP BY path")
def hidden_coupling(spark, d):
    return _round(coupling.coupling_score(_hidden(View(spark, d))), "coupling")


@query(
    "strongest_pair",
    PAIRS.format(most=20) + "SELECT path, partner, together FROM (SELECT a AS path, b AS partner, * FROM hidden UNION ALL SELECT b AS path, a AS partner, * FROM hidden) QUALIFY row_number() OVER (PARTITION BY path ORDER BY strength DESC, a, b) = 1",
)
def strongest_pair(spark, d):
    return coupling.strongest(_hidden(View(spark, d)))


@query("degrees", "SELECT node, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY node")
def degrees(spark, d):
    return graph.degrees(View(spark, d).edges)


@query("direct_dependents", "SELECT dst AS node, count(DISTINCT src) AS dependents FROM edges GROUP BY dst")
def direct_dependents(spark, d):
    return graph.direct_dependents(View(spark, d).edges)


@query("subgraph", "SELECT src, dst FROM edges WHERE src IN (SELECT path FROM files WHERE NOT is_test) AND dst IN (SELECT path FROM files WHERE NOT is_test)")
def subgraph(spark, d):
    v = View(spark, d)
    return graph.subgraph(v.edges, v.files.filter("NOT is_test").select(F.col("path").alias("node")))


def _seed(spark) -> DataFrame:
    return spark.range(1, 2).select(F.col("id").alias("node"))


def _walk(source: str, target: str, most: int, rel: str = "edges") -> str:
    return f", walk AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS hops UNION SELECT e.{target}, hops + 1 FROM walk JOIN {rel} e ON e.{source} = node WHERE hops < {most}), reach AS (SELECT node, min(hops) AS hops FROM walk GROUP BY node)"


@query("dependents", _walk("dst", "src", 3) + " SELECT node, hops FROM reach WHERE hops > 0")
def dependents(spark, d):
    return graph.dependents(View(spark, d).edges, _seed(spark), 3)


@query("dependencies", _walk("src", "dst", 3) + " SELECT node, hops FROM reach WHERE hops > 0")
def dependencies(spark, d):
    return graph.dependencies(View(spark, d).edges, _seed(spark), 3)


BOTH = ", both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"


@query("proximity", BOTH + _walk("src", "dst", 8, "both_ways") + " SELECT node, hops, round(pow(2.0, -hops / 2.0), 6) AS value FROM reach")
def proximity(spark, d):
    p = graph.proximity(View(spark, d).edges, _seed(spark))
    return p.select("node", "hops", F.round(scalar.hop_decay(F.col("hops")), 6).alias("value"))


STATIC = ", statics AS (SELECT DISTINCT src, dst FROM call_sites WHERE static)"


@query("blast_radius", STATIC + _walk("dst", "src", 2, "statics") + " SELECT node, hops FROM reach WHERE hops > 0 AND node NOT IN (SELECT path FROM files WHERE is_test)")
def blast_radius(spark, d):
    v = View(spark, d)
    return graph.blast_radius(v.call_sites.filter("static").select("src", "dst"), _seed(spark), v.files.filter("is_test").select(F.col("path").alias("node")))


def _pagerank_sql(rounds: int) -> str:
    n = "(SELECT count(*) FROM nodes)"
    parts = [", nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), outs AS (SELECT src, count(*) AS n FROM edges GROUP BY src)", f", r0 AS (SELECT node, 1.0::DOUBLE / {n} AS rank FROM nodes)"]
    for k in range(1, rounds + 1):
        parts.append(f""", r{k} AS (SELECT node, 0.15::DOUBLE / {n} + 0.85::DOUBLE * (coalesce(flow, 0) + (SELECT coalesce(sum(rank), 0) FROM r{k - 1} WHERE node NOT IN (SELECT src FROM outs)) / {n}) AS rank
  FROM nodes LEFT JOIN (SELECT dst AS node, sum(rank / n) AS flow FROM edges JOIN r{k - 1} ON node = src JOIN outs USING (src) GROUP BY dst) USING (node))""")
    return "".join(parts)


@query("pagerank_3", _pagerank_sql(3) + " SELECT node, round(rank * 1000, 6) AS rank FROM r3")
def pagerank_3(spark, d):
    e = View(spark, d).edges_table
    return graph.pagerank(e, graph.nodes_of(e), rounds=3, tolerance=0.0).select("node", F.round(F.col("rank") * 1000, 6).alias("rank"))


@query("pagerank")
def pagerank(spark, d):
    e = View(spark, d).edges_table
    return graph.pagerank(e, graph.nodes_of(e)).select("node", F.round(F.col("rank") * 1000, 6).alias("rank"))


@query("personalized_pagerank")
def personalized_pagerank(spark, d):
    e = View(spark, d).edges_table
    return graph.pagerank(e, graph.nodes_of(e), _seed(spark).withColumn("weight", F.lit(1.0))).select("node", F.round(F.col("rank") * 1000, 6).alias("rank"))


DAG = ", dag AS (SELECT DISTINCT from_pkg AS src, to_pkg AS dst FROM imports), dag_nodes AS (SELECT src AS node FROM dag UNION SELECT dst FROM dag)"
DEEP = DAG + ", deep AS (SELECT node, 0 AS depth FROM dag_nodes UNION SELECT dag.src, depth + 1 FROM deep JOIN dag ON dag.dst = node)"


def _dag(v: View) -> DataFrame:
    return v.imports.select(F.col("from_pkg").alias("src"), F.col("to_pkg").alias("dst"))


@query("dependency_depth", DEEP + " SELECT node, max(depth) AS depth FROM deep GROUP BY node")
def dependency_depth(spark, d):
    e = _dag(View(spark, d))
    return graph.dependency_depth(e, graph.components(e, graph.nodes_of(e)))


@query("topological_order", DEEP + " SELECT node, max(depth) AS depth FROM deep GROUP BY node ORDER BY depth, node")
def topological_order(spark, d):
    return graph.topological_order(dependency_depth(spark, d))


def _call_depth(v: View) -> DataFrame:
    """Depth over all call edges, static and dynamic; their cycles are condensed."""
    e = v.edges_table
    return graph.dependency_depth(e, graph.components(e, graph.nodes_of(e)))


@query("dependency_depth_calls")
def dependency_depth_calls(spark, d):
    return _call_depth(View(spark, d))


@query("topological_order_calls")
def topological_order_calls(spark, d):
    return graph.topological_order(_call_depth(View(spark, d)))



@query("components")
def components(spark, d):
    e = View(spark, d).edges_table
    return graph.components(e, graph.nodes_of(e))


SCORE = """, sig AS (SELECT symbol, is_test, generated, churn AS a, fix AS b FROM symbols LEFT JOIN churn USING (path)
  LEFT JOIN (SELECT path, sum(corrective::INT) AS fix FROM changes GROUP BY path) USING (path)),
na AS (SELECT symbol, CASE WHEN n = 1 THEN 1.0 ELSE (r + (c - 1) / 2.0) / (n - 1) END AS v FROM (SELECT symbol, rank() OVER (ORDER BY k) - 1 AS r, count(*) OVER (PARTITION BY k) AS c, count(*) OVER () AS n FROM (SELECT symbol, round(a, 6) AS k FROM sig WHERE round(a, 6) > 0))),
nb AS (SELECT symbol, CASE WHEN n = 1 THEN 1.0 ELSE (r + (c - 1) / 2.0) / (n - 1) END AS v FROM (SELECT symbol, rank() OVER (ORDER BY b) - 1 AS r, count(*) OVER (PARTITION BY b) AS c, count(*) OVER () AS n FROM sig WHERE b > 0)),
scored AS (SELECT symbol, round((coalesce(na.v, 0) * 0.15 + coalesce(nb.v, 0) * 0.15) / 0.30, 6) AS score FROM sig LEFT JOIN na USING (symbol) LEFT JOIN nb USING (symbol) WHERE NOT is_test AND NOT generated)
"""


def _score(v: View) -> DataFrame:
    changes = Scratch(v.spark, "changes").write(_changes(v).select("path", "ts", "now", "corrective"), "changes")
    churned = history.churn(changes).select("path", F.round("churn", 6).alias("value"))
    fixed = changes.groupBy("path").agg(F.count_if("corrective").cast("double").alias("value"))
    return _score_symbols(v, {"churn": churned, "fix_density": fixed})


def _score_symbols(v: View, signals: dict[str, DataFrame]) -> DataFrame:
    """symbol, score. signals: path, value. Each signal's value goes to all symbols of its file
    and is ranked among them: files are ranked with their number of symbols, which gives the
    same places, and only the scores go to the symbols."""
    scratch = Scratch(v.spark, "score")
    files = scratch.write(v.symbols.groupBy("path", "is_test", "generated").agg(F.count(F.lit(1)).alias("k")), "files")
    ranked = {k: ranking.percentile_rank(scratch.write(x.join(files.select("path", "k"), "path"), k), "path", "value", "rank", times="k") for k, x in signals.items()}
    ranked = {k: x.select(F.col("path").alias("symbol"), F.col("rank").alias("value")) for k, x in ranked.items()}
    scored = ranking.weighted_score(files.withColumnRenamed("path", "symbol"), ranked)
    scored = scratch.write(scored.select(F.col("symbol").alias("path"), F.round("score", 6).alias("score")), "scores")
    return v.symbols.select("symbol", "path").join(scored, "path").select("symbol", "score")


@query("composite_score", SCORE + "SELECT symbol, score FROM scored")
def composite_score(spark, d):
    return _score(View(spark, d)).select("symbol", "score")


@query(
    "reading_path",
    SCORE + "SELECT symbol, score, CASE WHEN score >= 0.70 * max(score) OVER () THEN 1 WHEN score >= 0.40 * max(score) OVER () THEN 2 ELSE 3 END AS tier FROM (SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, symbol LIMIT 40)",
)
def reading_path(spark, d):
    return ranking.tiers(ranking.top(_score(View(spark, d)), 40)).select("symbol", "score", "tier")


def _signals(v: View, **rounds) -> dict[str, DataFrame]:
    """path and value of the six signals that need no task, not normalised."""
    changes = Scratch(v.spark, "changes").write(_changes(v).select("path", "ts", "now", "corrective", "marked", "added"), "changes")
    e = v.edges_table
    rank = graph.pagerank(e, graph.nodes_of(e), **rounds).join(v.files.filter("NOT is_test").select(F.col("path").alias("node")), "node", "left_semi")
    found = {
        "centrality": rank.select(F.col("node").alias("path"), (F.col("rank") * 1000).alias("value")),
        "churn": history.churn(changes).withColumnRenamed("churn", "value"),
        "hidden_coupling": coupling.coupling_score(_hidden(v, e)).withColumnRenamed("coupling", "value"),
        "fix_density": history.fix_density(changes).withColumnRenamed("fix_density", "value"),
        "orphaning": history.orphaning(v.authorship, v.now).select("path", F.col("orphaning").alias("value")),
        "ai_density": history.ai_density(changes).withColumnRenamed("ai_density", "value"),
    }
    return {k: _round(x, "value") for k, x in found.items()}  # so that equal sums tie


def _score_all(v: View, **rounds) -> DataFrame:
    return _score_symbols(v, _signals(v, **rounds))


SIX = PAIRS.format(most=20) + _pagerank_sql(3) + """, sig AS (
  SELECT 0.20 AS w, node AS path, round(rank * 1000, 6) AS value FROM r3 WHERE node IN (SELECT path FROM files WHERE NOT is_test)
  UNION ALL SELECT 0.15, path, round(churn, 6) FROM churn
  UNION ALL SELECT 0.25, path, round(sum(strength), 6) FROM (SELECT a AS path, strength FROM hidden UNION ALL SELECT b, strength FROM hidden) GROUP BY path
  UNION ALL SELECT 0.1500001, path, round(f / n * ln(1 + f), 6) FROM (SELECT path, sum(corrective::INT)::DOUBLE AS f, count(*) AS n FROM changes GROUP BY path) WHERE f > 0
  UNION ALL SELECT 0.10, path, round(o / t * ln(1 + o), 6) FROM (SELECT path, sum(CASE WHEN coalesce(last_active < now - INTERVAL 90 DAY, true) THEN lines ELSE 0 END)::DOUBLE AS o, sum(lines) AS t FROM authorship, nowt GROUP BY path) WHERE t > 0 AND o > 0
  UNION ALL SELECT 0.05, path, round(a / t * ln(1 + a), 6) FROM (SELECT path, sum(CASE WHEN marked THEN added ELSE 0 END)::DOUBLE AS a, sum(added) AS t FROM changes GROUP BY path) WHERE a > 0 AND t > 0),
spread AS (SELECT w, symbol, value FROM sig JOIN symbols USING (path) WHERE value > 0),
placed AS (SELECT w, symbol, CASE WHEN n = 1 THEN 1.0 ELSE (r + (c - 1) / 2.0) / (n - 1) END AS v FROM (SELECT w, symbol, rank() OVER (PARTITION BY w ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY w, value) AS c, count(*) OVER (PARTITION BY w) AS n FROM spread)),
scored AS (SELECT symbol, round(coalesce(total, 0) / 0.90, 6) AS score FROM symbols LEFT JOIN (SELECT symbol, sum(round(w, 2)::DOUBLE * v) AS total FROM placed GROUP BY symbol) USING (symbol) WHERE NOT is_test AND NOT generated)
"""


@query("composite_score_six", SIX + "SELECT symbol, score FROM scored")
def composite_score_six(spark, d):
    """All six signals, with PageRank at three rounds so that SQL can follow."""
    return _score_all(View(spark, d), rounds=3, tolerance=0.0).select("symbol", "score")


@query(
    "reading_path_six",
    SIX + "SELECT symbol, score, CASE WHEN score >= 0.70 * max(score) OVER () THEN 1 WHEN score >= 0.40 * max(score) OVER () THEN 2 ELSE 3 END AS tier FROM (SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, symbol LIMIT 40)",
)
def reading_path_six(spark, d):
    chosen = ranking.top(_score_all(View(spark, d), rounds=3, tolerance=0.0), 40)
    return ranking.tiers(chosen).select("symbol", "score", "tier")


@query("composite_score_all")
def composite_score_all(spark, d):
    return _score_all(View(spark, d)).select("symbol", "score")


@query("reading_path_all")
def reading_path_all(spark, d):
    v = View(spark, d)
    chosen = Scratch(spark, "path").write(ranking.tiers(ranking.top(_score_all(v), 40)).select("symbol", "score", "tier"), "chosen")
    depth = _call_depth(v).withColumnRenamed("node", "path")
    depth = v.symbols.join(chosen, "symbol", "left_semi").join(depth, "path").select("symbol", "depth")
    return ranking.sequence(chosen, depth).select("symbol", "score", "tier", "depth")


ORDERED = ", ordered AS (SELECT *, row_number() OVER (ORDER BY ts, hash) - 1 AS pos FROM commits), newcomer AS (SELECT author, min(pos) AS first_pos, arg_min(ts, pos) AS first_seen FROM ordered GROUP BY author HAVING min(pos) >= 100)"
CASES = ORDERED + """, born AS (SELECT path, min(pos) AS born FROM commit_files JOIN ordered USING (hash) GROUP BY path),
touched AS (SELECT DISTINCT n.author, first_seen, first_pos, path FROM newcomer n JOIN ordered o ON o.author = n.author AND o.ts <= first_seen + INTERVAL 90 DAY JOIN commit_files USING (hash)),
cases AS (SELECT author, first_seen, first_pos, count(*) AS n_files FROM touched JOIN born USING (path) WHERE born < first_pos GROUP BY ALL HAVING count(*) >= 3)
"""


@query("find_cases", CASES + "SELECT author, first_seen, first_pos, n_files FROM cases")
def find_cases(spark, d):
    v = View(spark, d)
    return backtest.find_cases(v.commits, v.commit_files)


METRIC_SQL = CASES + """, truth AS (SELECT DISTINCT author AS c, path FROM touched WHERE author IN (SELECT author FROM cases)),
ranked AS (SELECT path, row_number() OVER (ORDER BY value DESC, path) AS pos FROM (SELECT path, sum(span) AS value FROM symbols WHERE NOT is_test GROUP BY path) WHERE value > 0),
per_case AS (SELECT t.c, sum(CASE WHEN pos <= 10 THEN 1 ELSE 0 END) AS hits, count(*) AS n, min(pos) AS first FROM truth t LEFT JOIN ranked r USING (path) GROUP BY t.c),
mets AS (SELECT c, hits / least(10, (SELECT count(*) FROM ranked))::DOUBLE AS p, hits / n::DOUBLE AS r, coalesce(1.0 / first, 0) AS rr FROM per_case)
"""


def _cases_truth(v: View) -> DataFrame:
    """case, item: what newcomers touch in their first 90 days."""
    cases = backtest.find_cases(v.commits, v.commit_files).select("author", "first_seen")
    own = v.commits.join(cases, "author").filter(F.col("ts") <= F.col("first_seen") + F.expr("INTERVAL 90 DAYS"))
    return own.join(v.commit_files, "hash").select(F.col("author").alias("case"), F.col("path").alias("item")).distinct()


def _metrics(v: View) -> DataFrame:
    """Largest files against what newcomers touch; one ranking serves all cases."""
    ranked = backtest.rank_files(history.largest_files(v.symbols)).select(F.col("path").alias("item"), "pos")
    return backtest.metrics_of_one(ranked, _cases_truth(v), "largest")


@query("backtest_metrics", METRIC_SQL + 'SELECT c AS case_id, round(p, 6) AS "precision", round(r, 6) AS recall, round(rr, 6) AS rr FROM mets')
def backtest_metrics(spark, d):
    return _round(_metrics(View(spark, d)), "precision", "recall", "rr").drop("strategy", "f1").withColumnRenamed("case", "case_id")


@query("backtest_summary", METRIC_SQL + "SELECT 'largest' AS strategy, count(*) AS cases, round(avg(p), 6) AS \"precision\", round(avg(r), 6) AS recall, round(avg(rr), 6) AS mrr, round(quantile_cont(p, 0.5), 6) AS median FROM mets")
def backtest_summary(spark, d):
    return _round(backtest.summarise(_metrics(View(spark, d))), "precision", "recall", "mrr", "median")


@query("size_bands", "SELECT item, size, CAST((row_number() OVER (ORDER BY size, item) - 1) * 4 // count(*) OVER () AS INT) AS band FROM (SELECT path AS item, CAST(sum(span) AS BIGINT) AS size FROM symbols WHERE NOT is_test GROUP BY path)")
def size_bands(spark, d):
    v = View(spark, d)
    return backtest.size_bands(history.largest_files(v.symbols).select(F.col("path").alias("item"), F.col("value").cast("long").alias("size")))


@query("matched_pairs")
def matched_pairs(spark, d):
    v = View(spark, d)
    c = v.files.filter("NOT is_test").select(F.col("package").alias("case"), F.lpad(F.col("path").cast("string"), 8, "0").alias("item"), F.col("span").cast("double").alias("size"), (F.col("dir") == "STANDARD").alias("truth"))
    return backtest.matched_pairs(c)


LIFT = PAIRS.format(most=20) + ", hot AS (SELECT a AS path FROM hidden UNION SELECT b FROM hidden), " + ORDERED[2:] + """, own AS (SELECT o.hash, corrective, hash IN (SELECT hash FROM commit_files JOIN hot USING (path)) AS coupled FROM ordered o JOIN newcomer n ON n.author = o.author AND o.ts <= first_seen + INTERVAL 90 DAY)
, s AS (SELECT count(*) AS commits, sum(coupled::INT) AS c_on, sum(corrective::INT) AS fixes, sum((corrective AND coupled)::INT) AS fixes_on FROM own)
SELECT commits, CAST(fixes AS BIGINT) AS fixes, round(c_on / commits, 6) AS base, round(fixes_on / fixes, 6) AS fix_rate, round((fixes_on / fixes) / (c_on / commits), 6) AS lift,
  CASE WHEN fixes < 15 THEN 'too few fixes' WHEN fixes_on < 5 THEN 'too few hits' WHEN c_on = 0 THEN 'never touched' WHEN (fixes_on / fixes) / (c_on / commits) >= 1.5 THEN 'strong' WHEN (fixes_on / fixes) / (c_on / commits) > 1.1 THEN 'modest' WHEN (fixes_on / fixes) / (c_on / commits) >= 0.9 THEN 'none' ELSE 'opposite' END AS verdict FROM s"""


@query("coupling_lift", LIFT)
def coupling_lift(spark, d):
    v = View(spark, d)
    found = _hidden(v)
    hot = found.select(F.explode(F.array("a", "b")).alias("path")).distinct()
    c = backtest.commit_order(v.commits)
    first = c.groupBy("author").agg(F.min(F.struct("pos", "ts")).alias("f")).filter("f.pos >= 100").select("author", F.col("f.ts").alias("first_seen"))
    own = c.join(first, "author").filter(F.col("ts") <= F.col("first_seen") + F.expr("INTERVAL 90 DAYS"))
    on = v.commit_files.join(hot, "path", "left_semi").select("hash").distinct().withColumn("on", F.lit(True))
    own = own.join(on, "hash", "left").select("corrective", F.coalesce("on", F.lit(False)).alias("coupled"))
    return _round(backtest.coupling_lift(own), "base", "fix_rate", "lift").select("commits", "fixes", "base", "fix_rate", "lift", "verdict")


@query("direction_questions", STATIC + " SELECT src AS symbol, min(dst) AS callee FROM statics s WHERE NOT EXISTS (SELECT 1 FROM statics t WHERE t.src = s.dst AND t.dst = s.src) GROUP BY src")
def direction_questions(spark, d):
    return probes.direction_questions(View(spark, d).call_sites.filter("static"))



@query(
    "blast_questions",
    ", pkg AS (SELECT from_pkg AS src, to_pkg AS dst FROM imports), one AS (SELECT dst AS symbol, src AS item FROM pkg), every_one AS (SELECT * FROM one UNION SELECT symbol, pkg.src FROM one JOIN pkg ON pkg.dst = item) SELECT symbol, array_to_string(list_sort(list(item)), ',') AS expected FROM every_one WHERE item <> symbol GROUP BY symbol HAVING count(*) BETWEEN 2 AND 12",
)
def blast_questions(spark, d):
    q = probes.blast_questions(_dag(View(spark, d)))
    return q.select("symbol", F.array_join("expected", ",").alias("expected"))


@query(
    "blast_questions_calls",
    STATIC + ", one AS (SELECT dst AS symbol, src AS item FROM statics), every_one AS (SELECT * FROM one UNION SELECT symbol, statics.src FROM one JOIN statics ON statics.dst = item) SELECT symbol, array_to_string(list_sort(list(item)), ',') AS expected FROM every_one WHERE item <> symbol AND item NOT IN (SELECT path FROM files WHERE is_test) GROUP BY symbol HAVING count(*) BETWEEN 2 AND 12",
)
def blast_questions_calls(spark, d):
    v = View(spark, d)
    q = probes.blast_questions(v.call_sites.filter("static"), tests=v.files.filter("is_test").select(F.col("path").alias("node")))
    return q.select("symbol", F.array_join(F.col("expected").cast("array<string>"), ",").alias("expected"))



def _events(v: View) -> DataFrame:
    e = v.table("events")
    kind = F.when(F.col("event_type") == "purchase", "edit").otherwise("probe")
    outcome = F.when(F.col("event_type") == "click", "correct").when(F.col("event_type") == "view", "incorrect").otherwise("skipped")
    return e.select(F.col("user_id").alias("symbol"), kind.alias("kind"), outcome.alias("outcome"), F.col("ts").alias("at"), (F.col("value") * 1000).cast("long").alias("elapsed_ms"))


ENGAGED = """, log AS (SELECT user_id AS symbol, CASE WHEN event_type = 'purchase' THEN 'edit' ELSE 'probe' END AS kind, CASE WHEN event_type = 'click' THEN 'correct' WHEN event_type = 'view' THEN 'incorrect' ELSE 'skipped' END AS outcome, ts AS moment FROM events),
eng AS (SELECT symbol, count(*) FILTER (kind = 'edit') AS edits, count(*) FILTER (kind = 'probe' AND outcome <> 'skipped') AS seen, count(*) FILTER (kind = 'probe' AND outcome = 'correct') AS correct, count(*) FILTER (kind = 'probe' AND outcome = 'skipped') AS skipped, min(moment) AS first_seen, max(moment) AS last_seen FROM log GROUP BY symbol)
"""


@query("engagement", ENGAGED + "SELECT * FROM eng")
def engagement(spark, d):
    return probes.engagement(_events(View(spark, d)))


@query(
    "familiarity",
    ENGAGED + """SELECT symbol, round(least(1.0, greatest(0.0, (1 - exp(-edits / 3.0) * (1 - coalesce(correct::DOUBLE / nullif(seen, 0), 0) * (1 - exp(-seen / 2.0)))) * CASE WHEN days > 0 THEN exp(-days / 90.0) ELSE 1 END)), 6) AS familiarity
  FROM (SELECT *, date_diff('day', last_seen::DATE, (SELECT max(last_seen)::DATE FROM eng)) AS days FROM eng)""",
)
def familiarity(spark, d):
    e = probes.engagement(_events(View(spark, d)))
    last = F.broadcast(e.agg(F.to_date(F.max("last_seen")).alias("now")))  # one row
    e = e.crossJoin(last).withColumn("days", F.date_diff("now", F.to_date("last_seen")))
    return e.select("symbol", F.round(scalar.familiarity(F.col("edits"), F.col("seen"), F.col("correct"), F.col("days")), 6).alias("familiarity"))


@query(
    "probe_health",
    ", l AS (SELECT event_type NOT IN ('click', 'view') AND event_type <> 'purchase' AS skip, CAST(floor(value * 1000) AS BIGINT) AS ms FROM events), t AS (SELECT list_sort(list(ms)) AS x FROM l WHERE NOT skip AND ms > 0) SELECT count(*) AS asked, count(*) FILTER (NOT skip) AS answered, count(*) FILTER (skip) AS skipped, (SELECT x[len(x) // 2 + 1] FROM t) AS median, coalesce((SELECT x[len(x) // 2 + 1] FROM t), 0) > 30000 OR (count(*) >= 5 AND count(*) FILTER (skip) / count(*) > 0.6) AS broken FROM l",
)
def probe_health(spark, d):
    e = View(spark, d).table("events")
    skip = ~F.col("event_type").isin("click", "view", "purchase")
    log = e.select(F.when(skip, "skipped").otherwise("answered").alias("outcome"), F.floor(F.col("value") * 1000).cast("long").alias("elapsed_ms"))
    return probes.health(log).select("asked", "answered", "skipped", "median", "broken")


@query("text_predicates", f"SELECT lang, count(*) FILTER (regexp_matches(text, '(?i)\\b({'|'.join(scalar.FIX_WORDS)})\\b')) AS fixes, count(*) FILTER (regexp_matches(text, '(?i)\\b({'|'.join(scalar.REVERT_WORDS)})\\b')) AS reverts, count(*) AS n FROM documents GROUP BY lang")
def text_predicates(spark, d):
    t = View(spark, d).table("documents")
    return t.groupBy("lang").agg(F.count_if(scalar.is_fix(F.col("text"))).alias("fixes"), F.count_if(scalar.is_revert(F.col("text"))).alias("reverts"), F.count(F.lit(1)).alias("n"))


@query("stats", "SELECT 'call_edges' AS name, count(*) AS n FROM call_sites UNION ALL SELECT 'commits', count(*) FROM commits UNION ALL SELECT 'commit_files', count(*) FROM commit_files UNION ALL SELECT 'files', count(*) FROM files UNION ALL SELECT 'imports', count(*) FROM imports UNION ALL SELECT 'symbols', count(*) FROM symbols")
def stats(spark, d):
    v = View(spark, d)
    parts = {"call_edges": v.call_sites, "commits": v.commits, "commit_files": v.commit_files, "files": v.files, "imports": v.imports, "symbols": v.symbols}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionAll(one)
    return out
