"""More bound queries: lookups, replay, signals, strata, lift, questions and parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathfold.functions import scalar
from pathfold.operators import backtest, coupling, graph, history, lookup, probes, ranking, replay
from pathfold.plans.queries import BOTH, CASES, ENGAGED, PAIRS, _cases_truth, _events, _hidden, _pagerank_sql, _round, _seed, _walk, query
from pathfold.sources import gitlog, store
from pathfold.sources.binding import View


def _file_nodes(v: View):
    """Files as graph nodes: symbol is the part, path its brand."""
    return v.files.select(F.col("path").alias("symbol"), F.col("package").alias("path"), "is_test")


@query("symbol_sizes", "SELECT symbol AS item, CAST(span AS BIGINT) AS size FROM symbols WHERE NOT is_test AND NOT generated")
def symbol_sizes(spark, d):
    return lookup.symbol_sizes(View(spark, d).symbols)


@query("largest_symbols", "SELECT symbol AS item, row_number() OVER (ORDER BY span DESC, symbol) AS pos FROM symbols WHERE NOT is_test AND NOT generated AND span > 0")
def largest_symbols(spark, d):
    sizes = lookup.symbol_sizes(View(spark, d).symbols).filter("size > 0")
    return backtest.numbered(sizes, [F.desc("size"), F.col("item")], "pos").select("item", "pos")


@query(
    "files_as_symbols",
    ", r AS (SELECT path, row_number() OVER (ORDER BY value DESC, path) AS pos FROM (SELECT path, sum(span) AS value FROM symbols WHERE NOT is_test GROUP BY path) WHERE value > 0) SELECT symbol AS item, pos AS file_pos, CAST(row_number() OVER (PARTITION BY path ORDER BY symbol % 1000000, symbol) AS INT) AS nth FROM symbols JOIN r USING (path) WHERE NOT is_test AND NOT generated",
)
def files_as_symbols(spark, d):
    v = View(spark, d)
    ranked = backtest.rank_files(history.largest_files(v.symbols))
    return lookup.lift_to_symbols(ranked, v.symbols.withColumn("start", F.col("symbol") % 1000000))


@query("file_edges", "SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM call_sites")
def file_edges(spark, d):
    v = View(spark, d)
    of = v.files.select(F.col("path").alias("symbol"), "path")
    return lookup.file_edges(v.edges, of)


@query("production_dependents", _walk("dst", "src", 3) + " SELECT node, hops FROM reach WHERE hops > 0 AND node NOT IN (SELECT path FROM files WHERE is_test)")
def production_dependents(spark, d):
    v = View(spark, d)
    return lookup.partition_by_test(graph.dependents(v.edges, _seed(spark), 3), _file_nodes(v))[0].select("node", "hops")


@query("tests_per_file", _walk("dst", "src", 3) + " SELECT package AS path, count(*) AS n FROM reach JOIN files ON path = node WHERE hops > 0 AND is_test GROUP BY package")
def tests_per_file(spark, d):
    v = View(spark, d)
    return lookup.tests_per_file(lookup.partition_by_test(graph.dependents(v.edges, _seed(spark), 3), _file_nodes(v))[1], _file_nodes(v))


@query("dependents_by_hop", _walk("dst", "src", 3) + " SELECT hops, count(*) AS n, array_to_string(list_sort(list(node)), ',') AS nodes FROM reach WHERE hops > 0 GROUP BY hops")
def dependents_by_hop(spark, d):
    found = lookup.by_hop(graph.dependents(View(spark, d).edges, _seed(spark), 3))
    return found.select("hops", "n", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"))


@query("covering_tests", "SELECT DISTINCT l_suppkey AS test FROM lineitem WHERE l_partkey = 1 AND l_discount >= 0.1")
def covering_tests(spark, d):
    li = View(spark, d).table("lineitem")
    cover = li.select(F.col("l_suppkey").alias("test"), F.col("l_partkey").alias("symbol"), F.col("l_discount").alias("fraction"))
    return lookup.covering_tests(cover, 1)


@query("merged_coverage", "SELECT l_suppkey AS test, l_partkey AS symbol, max(l_discount) AS fraction FROM lineitem GROUP BY ALL")
def merged_coverage(spark, d):
    li = View(spark, d).table("lineitem")
    return store.merge_coverage(li.select(F.col("l_suppkey").alias("test"), F.col("l_partkey").alias("symbol"), F.col("l_discount").alias("fraction")))


@query("has_markers", "SELECT coalesce(bool_or(marked), false) AS has_markers FROM commits")
def has_markers(spark, d):
    return lookup.has_markers(View(spark, d).commits)


@query("point_lookup", "SELECT 1 AS path, CAST((SELECT span FROM files WHERE path = 1) AS BIGINT) AS span UNION ALL SELECT -1, 0")
def point_lookup(spark, d):
    files = View(spark, d).files.select(F.col("path").cast("int"), F.col("span").cast("long"))
    return lookup.point(files, "path", 1).unionAll(lookup.point(files, "path", -1, {"span": 0}))


def _places(v: View):
    """Nations as symbols, their region as package and path; every fifth is a test."""
    n = v.table("nation").join(v.table("region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
    return n.select(F.concat(F.lit("m/"), F.col("r_name"), F.lit("."), F.col("n_name")).alias("symbol"), F.col("n_name").alias("name"), F.concat(F.lit("m/"), F.col("r_name")).alias("package"), F.concat(F.col("r_name"), F.lit("/"), F.col("n_name"), F.lit(".x")).alias("path"), (F.col("n_nationkey") % 5 == 0).alias("is_test"))


PLACES = ", places AS (SELECT 'm/' || r_name || '.' || n_name AS symbol, r_name || '.' || n_name AS short, n_name AS name, 'm/' || r_name AS package, n_nationkey % 5 = 0 AS is_test FROM nation JOIN region ON r_regionkey = n_regionkey)"


@query("find_symbol", PLACES + " SELECT 'near' AS outcome, array_to_string(list_slice(list_sort(list(DISTINCT short)), 1, 8), ',') AS symbols FROM places WHERE NOT is_test AND contains(lower(name), 'n') HAVING count(*) > 0")
def find_symbol(spark, d):
    return lookup.find_symbol(_places(View(spark, d)), "N").select("outcome", F.array_join("symbols", ",").alias("symbols"))


@query("resolve_task", PLACES + " SELECT symbol FROM places WHERE NOT is_test AND package = (SELECT min(package) FROM places WHERE NOT is_test)")
def resolve_task(spark, d):
    v = View(spark, d)
    first = _places(v).filter("NOT is_test").agg(F.min("package").alias("p")).first()["p"]
    return ranking.resolve_task(_places(v), f" {first.removeprefix('m/').lower()}/ ")


RENAMES = ", moved AS (SELECT pos, path, CASE WHEN added % 11 = 0 THEN path - 1 END AS renamed FROM commit_files JOIN (SELECT hash, row_number() OVER (ORDER BY ts, hash) - 1 AS pos FROM commits) USING (hash))"


@query(
    "files_as_of",
    RENAMES + ", ev AS (SELECT path AS name, pos, path AS maker, 1 AS there FROM moved UNION ALL SELECT renamed, pos, path, 0 FROM moved WHERE renamed IS NOT NULL) SELECT name AS path FROM (SELECT name, there, row_number() OVER (PARTITION BY name ORDER BY pos DESC, maker DESC, there DESC) AS k FROM ev) WHERE k = 1 AND there = 1",
)
def files_as_of(spark, d):
    v = View(spark, d)
    moved = v.commit_files.join(backtest.commit_order(v.commits).select("hash", "pos"), "hash")
    return replay.files_as_of(moved.select("pos", "path", F.when(F.col("added") % 11 == 0, F.col("path") - 1).alias("renamed")))


@query("targets_corrected", ", t AS (SELECT DISTINCT author, path FROM commits JOIN commit_files USING (hash) WHERE corrective) SELECT author AS case_id, path AS item FROM t WHERE author IN (SELECT author FROM t GROUP BY author HAVING count(*) >= 2)")
def targets_corrected(spark, d):
    v = View(spark, d)
    touched = v.commits.join(v.commit_files, "hash").select(F.col("author").alias("case"), F.col("path").alias("item"), "corrective")
    return replay.targets(touched, "corrected").select(F.col("case").alias("case_id"), "item")


@query("top_coupled_pairs", PAIRS.format(most=20) + "SELECT a, b, together FROM hidden ORDER BY together DESC, strength DESC, a, b LIMIT 20")
def top_coupled_pairs(spark, d):
    return coupling.top_pairs(_hidden(View(spark, d)), 20).select("a", "b", "together")


@query("hidden_for", PAIRS.format(most=20) + ", one AS (SELECT min(a) AS path FROM hidden) SELECT CASE WHEN a = one.path THEN b ELSE a END AS partner, together, round(strength, 6) AS strength FROM hidden, one WHERE a = one.path OR b = one.path")
def hidden_for(spark, d):
    found = _hidden(View(spark, d))
    return _round(coupling.hidden_for(found, found.agg(F.min("a")).first()[0]), "strength")


REPOS = ", lifts AS (SELECT author % 7 AS repo, CAST(sum(corrective::INT) AS BIGINT) AS fixes, CAST(sum((corrective AND marked)::INT) AS BIGINT) AS fixes_on, avg(marked::INT) AS base FROM commits GROUP BY 1), pooled AS (SELECT sum(fixes) AS f, sum(fixes_on) AS o, sum(base * fixes) FILTER (base > 0 AND fixes > 0) / sum(fixes) FILTER (base > 0 AND fixes > 0) AS b FROM lifts)"


@query(
    "pooled_lift",
    REPOS + " SELECT CAST(f AS BIGINT) AS fixes, CAST(o AS BIGINT) AS fixes_on, round(b, 6) AS base, round(o / f, 6) AS fix_rate, round(o / f / b, 6) AS lift, CASE WHEN f < 15 THEN 'too few fixes' WHEN o < 5 THEN 'too few hits' WHEN o / f / b >= 1.5 THEN 'strong' WHEN o / f / b > 1.1 THEN 'modest' WHEN o / f / b >= 0.9 THEN 'none' ELSE 'opposite' END AS verdict FROM pooled",
)
def pooled_lift(spark, d):
    c = View(spark, d).commits
    lifts = c.groupBy((F.col("author") % 7).alias("repo")).agg(F.count_if("corrective").alias("fixes"), F.count_if(F.col("corrective") & F.col("marked")).alias("fixes_on"), F.avg(F.col("marked").cast("int")).alias("base"))
    return _round(backtest.pooled_lift(lifts), "base", "fix_rate", "lift").select("fixes", "fixes_on", "base", "fix_rate", "lift", "verdict")


BANDS = ", s AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'own' ELSE 'other' END AS strategy, o_custkey % 4 AS band, (o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT AS hit FROM orders), b AS (SELECT strategy, band, avg(hit) AS p, band * 1.5 AS spread FROM s GROUP BY ALL), overall AS (SELECT avg(hit) FILTER (strategy = 'own') AS own, avg(hit) FILTER (strategy = 'other') AS other FROM s), j AS (SELECT x.p, y.p AS q, x.spread FROM b x JOIN b y ON x.band = y.band AND x.strategy = 'own' AND y.strategy = 'other'), g AS (SELECT count(*) AS n, count(*) FILTER (p > q) AS wins, count(*) FILTER (spread > 0 AND spread <= 4) AS tight, coalesce(avg(p - q) FILTER (spread > 0 AND spread <= 4), 0) AS tight_gap, coalesce(avg(p - q), 0) AS mean_gap FROM j)"


@query(
    "strata_reading",
    BANDS + " SELECT n, wins, tight, round(tight_gap, 6) AS tight_gap, round(mean_gap, 6) AS mean_gap, CASE WHEN n = 0 THEN 'no band could be scored' WHEN own > other THEN 'leads overall' WHEN wins = n THEN 'trails overall, wins every band' WHEN wins = 0 AND tight > 0 AND -tight_gap < 0.015 THEN 'adds nothing over size' WHEN wins = 0 THEN 'trails in every band' WHEN mean_gap <= -0.045 THEN 'trails by the margin' ELSE 'mixed' END AS reading FROM g, overall",
)
def strata_reading(spark, d):
    o = View(spark, d).table("orders")
    s = o.select(F.when(F.col("o_orderstatus") == "F", "own").otherwise("other").alias("strategy"), (F.col("o_custkey") % 4).alias("band"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("hit"))
    bands = s.groupBy("strategy", "band").agg(F.avg("hit").alias("precision"), F.count(F.lit(1)).alias("cases")).withColumn("spread", F.col("band") * 1.5)
    overall = s.groupBy("strategy").agg(F.avg("hit").alias("precision"))
    return _round(backtest.read_strata(overall, bands, "own", "other"), "tight_gap", "mean_gap")


STRATA = CASES + """, truth AS (SELECT DISTINCT author AS c, path FROM touched WHERE author IN (SELECT author FROM cases)),
sized AS (SELECT path, CAST(sum(span) AS BIGINT) AS size FROM symbols WHERE NOT is_test GROUP BY path), banded AS (SELECT path, size, (row_number() OVER (ORDER BY size, path) - 1) * 4 // count(*) OVER () AS band FROM sized),
kq AS (SELECT band, least(10, count(*) // 2) AS kq, max(size) / nullif(min(size), 0) AS spread FROM banded GROUP BY band HAVING least(10, count(*) // 2) >= 3),
shown AS (SELECT path, band, kq, spread, row_number() OVER (PARTITION BY band ORDER BY size DESC, path) AS r FROM banded JOIN kq USING (band) WHERE size > 0),
live AS (SELECT DISTINCT c, band FROM truth JOIN banded USING (path))
"""


@query(
    "stratified_precision",
    STRATA + "SELECT l.c AS case_id, CAST(l.band AS INT) AS band, round(count(t.path) / any_value(s.kq), 6) AS \"precision\", round(any_value(s.spread), 6) AS spread FROM live l JOIN shown s ON s.band = l.band AND s.r <= s.kq LEFT JOIN truth t ON t.c = l.c AND t.path = s.path GROUP BY l.c, l.band",
)
def stratified_precision(spark, d):
    v = View(spark, d)
    sizes = history.largest_files(v.symbols).select(F.col("path").alias("item"), F.col("value").cast("long").alias("size"))
    banded, truth = backtest.size_bands(sizes), _cases_truth(v)
    # within a band only its first places count, so no case repeats the whole ranking
    first = backtest.rank_files(banded.select(F.col("item").alias("path"), F.col("size").alias("value"), "band"), ["band"]).filter(F.col("pos") <= backtest.K)
    predicted = truth.select("case").distinct().crossJoin(F.broadcast(first)).select("case", F.lit("largest").alias("strategy"), F.col("path").alias("item"), "pos")  # 40 rows
    found = backtest.stratified_precision(predicted, truth, banded)
    return _round(found, "precision", "spread").select(F.col("case").alias("case_id"), "band", "precision", "spread")


@query("case_fingerprint", CASES + "SELECT substr(sha256(string_agg(name || chr(0), '' ORDER BY name)), 1, 12) AS case_set FROM (SELECT 'c' || lpad(author::VARCHAR, 9, '0') AS name FROM cases)")
def case_fingerprint(spark, d):
    v = View(spark, d)
    cases = backtest.find_cases(v.commits, v.commit_files)
    return backtest.fingerprint(cases.select(F.concat(F.lit("c"), F.lpad(F.col("author").cast("string"), 9, "0")).alias("name")))


@query("churn_quantile", "SELECT round(quantile_cont(churn, 0.9), 6) AS quantile FROM churn")
def churn_quantile(spark, d):
    v = View(spark, d)
    return _round(ranking.quantile(history.churn(v.windowed(365).join(v.commit_files, "hash")), "churn", 0.9), "quantile")


@query("centrality_signal", _pagerank_sql(3) + " SELECT node, round(rank * 1000, 6) AS value FROM r3 WHERE node IN (SELECT path FROM files WHERE NOT is_test)")
def centrality_signal(spark, d):
    v = View(spark, d)
    ranks = graph.pagerank(v.edges, graph.nodes_of(v.edges), rounds=3, tolerance=0.0)
    return ranking.centrality_signal(ranks, _file_nodes(v)).select("node", F.round(F.col("value") * 1000, 6).alias("value"))


@query("proximity_signal", BOTH + _walk("src", "dst", 8, "both_ways") + " SELECT node, round(pow(2.0, -hops / 2.0), 6) AS value FROM reach WHERE node NOT IN (SELECT path FROM files WHERE is_test)")
def proximity_signal(spark, d):
    v = View(spark, d)
    return _round(ranking.proximity_signal(graph.proximity(v.edges, _seed(spark)), _file_nodes(v)), "value")


LOG = ", asked AS (SELECT user_id AS symbol, ts AS asked_at FROM events WHERE event_type <> 'purchase'), last AS (SELECT max(ts) AS now FROM events), candidates AS (SELECT DISTINCT user_id AS symbol, user_id % 10 = 0 AS is_test FROM events)"


@query("eligible_candidates", LOG + " SELECT symbol FROM candidates WHERE NOT is_test AND symbol NOT IN (SELECT symbol FROM asked, last WHERE asked_at >= now - INTERVAL 1 HOUR)")
def eligible_candidates(spark, d):
    e = View(spark, d).table("events")
    now = F.lit(e.agg(F.max("ts")).first()[0])
    log = e.filter("event_type <> 'purchase'").select(F.col("user_id").alias("symbol"), F.col("ts").alias("asked_at"))
    return probes.eligible(log, e.select(F.col("user_id").alias("symbol"), (F.col("user_id") % 10 == 0).alias("is_test")).distinct(), now, F.expr("INTERVAL 1 HOUR")).select("symbol")


@query("has_engaged", ENGAGED + "SELECT CAST(symbol AS BIGINT) AS symbol, true AS engaged FROM eng WHERE symbol = (SELECT min(symbol) FROM eng) UNION ALL SELECT -1, false")
def has_engaged(spark, d):
    seen = probes.engagement(_events(View(spark, d))).select(F.col("symbol").cast("long"), F.lit(True).alias("engaged"))
    least = seen.agg(F.min("symbol")).first()[0]
    return lookup.point(seen, "symbol", least).unionAll(lookup.point(seen, "symbol", -1, {"engaged": False}))


@query("next_question", ", statics AS (SELECT DISTINCT src, dst FROM call_sites WHERE static), ok AS (SELECT src AS symbol FROM statics s WHERE NOT EXISTS (SELECT 1 FROM statics t WHERE t.src = s.dst AND t.dst = s.src)) SELECT min(symbol) AS symbol, 'direction' AS kind FROM ok")
def next_question(spark, d):
    v = View(spark, d)
    s = v.call_sites.filter("static")
    candidates = v.files.select(F.col("path").alias("symbol"), F.col("path").alias("pos"))
    return probes.next_question(candidates, ("locate", candidates.limit(0)), ("direction", probes.direction_questions(s)))


@query(
    "graded_choices",
    ", a AS (SELECT o_orderkey AS id, o_custkey % 5 AS c, o_custkey % 3 AS k FROM orders) SELECT id, CASE WHEN c = 4 THEN 'skipped' WHEN c = k THEN 'correct' ELSE 'incorrect' END AS outcome FROM a",
)
def graded_choices(spark, d):
    o = View(spark, d).table("orders")
    c = F.col("o_custkey") % 5
    a = o.select(F.col("o_orderkey").alias("id"), probes.choice(F.when(c == 4, "skip").otherwise((c + 1).cast("string")), 4).alias("choice"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("labels"), (F.col("o_custkey") % 3).cast("int").alias("right"), F.lit("the graph").alias("provenance"))
    return probes.grade_choice(a).select("id", "outcome")


@query("parsed_commits", "SELECT CAST(hash AS VARCHAR) AS hash, count(*) AS files, CAST(sum(added) AS BIGINT) AS added FROM commit_files GROUP BY hash")
def parsed_commits(spark, d):
    """The history written as a log, and read again."""
    v = View(spark, d)
    first = F.lit(-(1 << 63))  # before any path
    head = v.commit_files.select("hash").distinct().select(F.col("hash").cast("string").alias("repo"), first.alias("pos"), F.concat(F.lit("\x02"), F.col("hash").cast("string"), F.lit("\x1fA\x1fa@b\x1f100\x1fsubject")).alias("line"))
    row = v.commit_files.select(F.col("hash").cast("string").alias("repo"), F.col("path").cast("long").alias("pos"), F.concat(F.col("added").cast("string"), F.lit("\t0\tf"), F.col("path").cast("string"), F.lit(".c")).alias("line"))
    return gitlog.parse_log(head.unionAll(row))[1].groupBy("hash").agg(F.count(F.lit(1)).alias("files"), F.sum("added").alias("added"))


@query("scalar_texts", "SELECT p_partkey AS path, CAST(p_size AS VARCHAR) || CASE WHEN p_size = 1 THEN ' line' ELSE ' lines' END AS size, CASE WHEN p_size % 3 = 1 THEN 'start here' WHEN p_size % 3 = 2 THEN 'then these' ELSE 'when you get to it' END AS label FROM part")
def scalar_texts(spark, d):
    p = View(spark, d).table("part")
    return p.select(F.col("p_partkey").alias("path"), scalar.plural(F.col("p_size"), "line", "lines").alias("size"), scalar.tier_label(F.col("p_size") % 3).alias("label"))
