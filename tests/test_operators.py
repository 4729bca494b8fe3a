from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pathfold.functions import scalar
from pathfold.operators import backtest, coupling, graph, history, probes, ranking
from pathfold.sources import gitlog
from pathfold.sources.store import Store

NOW = datetime(2026, 6, 1)


def edges(spark, *pairs):
    return spark.createDataFrame([tuple(p.split(">")) for p in pairs], "src string, dst string")


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x"))).collect()]


def test_scalars(spark):
    assert column(spark, ["a.b/c.(*R).M", "x/y.F", "z"], scalar.package_of) == ["a.b/c", "x/y", ""]
    assert column(spark, ["example.com/s/billing.Cycle"], scalar.short_id) == ["billing.Cycle"]
    assert column(spark, ["Fixed it", "fixing", "prefix", "a HOTFIX"], scalar.is_fix) == [True, False, False, True]
    assert column(spark, ["Revert x", "reverting", "irreverted"], scalar.is_revert) == [True, True, False]
    assert column(spark, ["abc", ""], scalar.fnv1a_32) == [440920331, 2166136261]
    assert column(spark, ["a_test.go", "testdata/x.go", "b.go"], scalar.is_test_file) == [True, True, False]
    assert column(spark, ["(Foo),"], scalar.normalise_token) == ["foo"]


def test_normaliser_ties(spark):
    for values, want in (([1.0, 1.0, 2.0, 5.0, 0.0], [1 / 6, 1 / 6, 2 / 3, 1.0]), ([7.0], [1.0])):
        rows = spark.createDataFrame(list(enumerate(values)), "k int, v double")
        got = [r["out"] for r in ranking.percentile_rank(rows, "k", "v", "out").orderBy("k").collect()]
        assert got == pytest.approx(want)


def test_churn_and_rename(spark):
    rows = [("a", NOW, NOW, ""), ("a", NOW - timedelta(days=182), NOW, ""), ("b", NOW, NOW, "old")]
    got = dict(history.churn(spark.createDataFrame(rows, "path string, ts timestamp, now timestamp, renamed string")).collect())
    assert got == pytest.approx({"a": 1.5, "b": 1.0, "old": 1.0})


def test_coupling(spark):
    rows = [(h, p) for h in range(4) for p in ("ser", "schema")] + [(h, "handler") for h in range(4, 8)]
    changes = spark.createDataFrame(rows, "hash int, path string")
    files = spark.createDataFrame([("ser", "p", "d"), ("handler", "q", "d")], "path string, package string, dir string")
    none = spark.createDataFrame([], "from_pkg string, to_pkg string")
    found = coupling.pairs(changes, files)
    assert [tuple(r) for r in coupling.hidden(found, edges(spark, "x>y"), files, none).collect()] == [("schema", "ser", 4, 1.0)]
    assert coupling.hidden(found, edges(spark, "ser>schema"), files, none).count() == 0
    assert coupling.pairs(changes, files, least_support=5).count() == 0


@pytest.mark.parametrize("pairs", [("a>b", "b>c", "c>a", "a>c", "d>a"), ("a>l1", "a>l2", "b>l1")])
def test_pagerank_mass(spark, pairs):
    e = edges(spark, *pairs)
    ranks = graph.pagerank(e, graph.nodes_of(e), rounds=15)
    assert ranks.agg(F.sum("rank")).first()[0] == pytest.approx(1.0, abs=1e-6)


def test_reach(spark):
    e = edges(spark, "a>b", "b>c", "c>a", "x>y")
    seed = spark.createDataFrame([("a",)], "node string")
    assert dict(graph.reachable(e, seed).collect()) == {"a": 0, "b": 1, "c": 2}
    assert dict(graph.dependents(e, seed, 1).collect()) == {"c": 1}
    assert graph.dependents(e, spark.createDataFrame([("q",)], "node string")).count() == 0


def test_components_and_depth(spark):
    e = edges(spark, "a>b", "b>a", "b>c", "c>d", "e>e")
    comps = graph.components(e, graph.nodes_of(e))
    assert dict(comps.collect()) == {"a": "b", "b": "b", "c": "c", "d": "d", "e": "e"}
    assert dict(graph.dependency_depth(e, comps).collect()) == {"a": 2, "b": 2, "c": 1, "d": 0, "e": 0}


def test_tiers(spark):
    s = spark.createDataFrame([("a", 1.0), ("b", 0.75), ("c", 0.5), ("d", 0.1)], "symbol string, score double")
    for scale in (1.0, 0.1):
        got = ranking.tiers(s.withColumn("score", F.col("score") * scale)).orderBy("symbol")
        assert [r["tier"] for r in got.collect()] == [1, 1, 2, 3]


def test_size_bands(spark):
    s = spark.createDataFrame([(f"i{k}", v) for k, v in enumerate([1, 2, 3, 4, 5, 6, 7, 5000])], "item string, size long")
    assert [r["band"] for r in backtest.size_bands(s).orderBy("size").collect()] == [0, 0, 1, 1, 2, 2, 3, 3]


def test_matched_calibration(spark):
    """A ranking by size tells nothing about pairs of one size; one by truth wins them all."""
    rows = [("c", f"s{i:04d}", float(3 + (i * 7919) % 41), i % 9 == 0) for i in range(720)]
    c = spark.createDataFrame(rows, "case string, item string, size double, truth boolean")
    pairs = backtest.matched_pairs(c)
    by_size = sorted(rows, key=lambda r: (-r[2], r[1]))
    oracle = sorted(rows, key=lambda r: (not r[3], r[1]))
    ranked = [("c", n, r[1], k + 1) for n, rs in (("size", by_size), ("oracle", oracle)) for k, r in enumerate(rs)]
    got = {r["strategy"]: r["matched"] for r in backtest.matched_score(pairs, spark.createDataFrame(ranked, "case string, strategy string, item string, pos int")).collect()}
    assert got["oracle"] == pytest.approx(1.0) and abs(got["size"] - 0.5) < 0.12


def test_matched_pairs_by_brute_force(spark):
    import random

    draw = random.Random(4)
    rows = [(f"c{i % 3}", f"i{i:03d}", float(draw.choice([0, 1, 2, 2.4, 3, 5, 8, 9, 20])), draw.random() < 0.4) for i in range(150)]
    got = {(r["case"], r["item"]): r["twin"] for r in backtest.matched_pairs(spark.createDataFrame(rows, "case string, item string, size double, truth boolean")).collect()}
    want = {}
    for case in ("c0", "c1", "c2"):
        free = [(r[2], r[1]) for r in rows if r[0] == case and not r[3]]
        for size, item in sorted(((r[2], r[1]) for r in rows if r[0] == case and r[3]), key=lambda x: x[1]):
            if size <= 0 or not free:
                continue
            least = min(abs(s - size) for s, _ in free)
            tied = sorted((n, s) for s, n in free if abs(s - size) == least)
            twin, s = tied[backtest.fnv1a_64(item) % len(tied)]
            if s > 0 and max(s, size) / min(s, size) <= backtest.RATIO:
                free.remove((s, twin))
                want[case, item] = twin
    assert got == want and len(want) > 20


def test_verdict_tie_is_a_loss(spark):
    s = spark.createDataFrame([("own", 0.5), ("a", 0.5), ("b", 0.4), ("ctl", 0.9)], "strategy string, precision double")
    v = backtest.verdict(s, "own", ["a", "b"], ["ctl"]).first()
    assert (v["passed"], v["beaten"], v["lost"], v["outscored"]) == (False, ["b"], ["a"], ["ctl"])
    assert backtest.verdict(s, "own", ["b"], ["ctl"]).first()["hollow"]


def test_probe_grading(spark):
    q = spark.createDataFrame([("s", ["a", "b"])], "symbol string, expected array<string>")
    names = spark.createDataFrame([("a", "a"), ("b", "b"), ("z", "z")], "name string, item string")
    answers = spark.createDataFrame([(1, "s", "a, b"), (2, "s", "z"), (3, "s", "skip")], "id int, symbol string, answer string")
    got = {r["id"]: r["outcome"] for r in probes.grade_blast(answers, q, names).collect()}
    assert got == {1: "correct", 2: "incorrect", 3: "skipped"}


def test_parsers(spark):
    paths = ["src/{core => model}/tree.py", "lib/{ => v2}/io.py", "lib/{v1 => }/io.py", "old name.txt => new name.txt", "plain.txt"]
    assert column(spark, paths, gitlog.new_path) == ["src/model/tree.py", "lib/v2/io.py", "lib/io.py", "new name.txt", "plain.txt"]
    assert column(spark, paths, gitlog.old_path) == ["src/core/tree.py", "lib/io.py", "lib/v1/io.py", "old name.txt", ""]
    lines = ["\x02c1\x1fBo\x1fbo@y\x1f250\x1fmend it", "7\t0\tk.py", "-\t-\tpic.gif", "\x02broken", "4\t4\tlost.py"]
    rows = spark.createDataFrame([("r", i, v) for i, v in enumerate(lines)], "repo string, pos int, line string")
    commits, files = gitlog.parse_log(rows)
    assert [r["hash"] for r in commits.collect()] == ["c1"]
    assert sorted((r["path"], r["added"], r["deleted"]) for r in files.collect()) == [("k.py", 7, 0), ("pic.gif", 0, 0)]
    diff = ["+++ b/k.py", "@@ -3,9 +5,2 @@ def f", "@@ -40 +41 @@", "@@ -50,2 +50,0 @@", "+++ /dev/null", "@@ -2 +2 @@"]
    rows = spark.createDataFrame([("h", i, v) for i, v in enumerate(diff)], "hash string, pos int, line string")
    assert sorted((r["start"], r["count"]) for r in gitlog.parse_hunks(rows).collect()) == [(5, 2), (41, 1), (50, 0)]


def test_manifest_rules():
    good = {"version": 1, "repos": [{"name": "a/b", "url": "https://x/a/b", "rev": "0" * 40}]}
    gitlog.check_manifest(good)
    for bad in ({"version": 2}, {**good, "repos": [{**good["repos"][0], "url": "http://x"}]}, {**good, "repos": good["repos"] * 2}):
        with pytest.raises(ValueError):
            gitlog.check_manifest(bad)


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    for k in (1, 2):
        store.write_index({"import_edges": spark.createDataFrame([("a", str(k))], "from_pkg string, to_pkg string")})
    assert [r["to_pkg"] for r in store.table("import_edges").collect()] == ["2"]
