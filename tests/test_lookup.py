"""Lookups, replay, sources, task resolution, lift and strata rules, and questions on own inputs."""

import subprocess
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pathfold.functions import scalar
from pathfold.operators import backtest, coupling, lookup, probes, ranking, replay
from pathfold.sources import facts, gitlog

NOW = datetime(2026, 3, 1)
SYMBOLS = [
    ("shop/cart.Add", "Add", "shop/cart", "shop/cart/add.py", False), ("shop/cart.Total", "Total", "shop/cart", "shop/cart/sum.py", False),
    ("shop/tax.Rate", "Rate", "shop/tax", "shop/tax/rate.py", False), ("old/tax.rate", "rate", "old/tax", "old/tax/rate.py", False),
    ("shop/cart.TestAdd", "TestAdd", "shop/cart", "shop/cart/add_test.py", True), ("x.Order", "Order", "x", "main.py", False),
]


@pytest.fixture(scope="module")
def symbols(spark):
    return spark.createDataFrame(SYMBOLS, "symbol string, name string, package string, path string, is_test boolean")


def test_resolve_task(spark, symbols):
    seeds = lambda task: sorted(r[0] for r in ranking.resolve_task(symbols, task).collect())
    assert seeds("SHOP/TAX.rate") == ["shop/tax.Rate"] and seeds("cart.total") == ["shop/cart.Total"]
    assert seeds("tax") == ["old/tax.rate"]  # the shortest package that ends so
    assert seeds(" Shop\\Cart/ ") == ["shop/cart.Add", "shop/cart.Total"]
    assert seeds("shop") == ["shop/cart.Add", "shop/cart.Total", "shop/tax.Rate"] and seeds("main.py") == ["x.Order"]
    assert seeds("tota") == ["shop/cart.Total"] and seeds("r") == [] and seeds("  ") == []


def test_find_symbol(spark, symbols):
    find = lambda q: tuple(lookup.find_symbol(symbols, q).first())
    assert find("shop/cart.TestAdd") == ("found", ["shop/cart.TestAdd"]) and find("TestAdd") == ("none", [])
    assert find("Add") == ("found", ["shop/cart.Add"]) and find("Rate") == ("found", ["shop/tax.Rate"])
    assert find("RATE") == ("ambiguous", ["old/tax.rate", "shop/tax.Rate"])
    assert find("ota") == ("near", ["cart.Total"]) and find("zzz") == ("none", [])


def test_resolve_names(spark):
    names = spark.createDataFrame([("Cart.Add", 1), ("Add", 2), ("tax", 3)], "name string, item int")
    tokens = spark.createDataFrame([(1, "(add),"), (2, "a.cart.add"), (3, "nothing"), (4, "Tax"), (5, "")], "id int, token string")
    got = sorted((r["id"], r["item"]) for r in lookup.resolve_names(tokens, names).collect())
    assert got == [(1, 2), (2, 1), (2, 2), (4, 3)]


def test_groups_and_lookups(spark, symbols):
    found = spark.createDataFrame([("shop/cart.Add", 2), ("shop/cart.TestAdd", 1), ("x.Order", 1)], "node string, hops int")
    production, tests = lookup.partition_by_test(found, symbols)
    assert sorted(r["node"] for r in production.collect()) == ["shop/cart.Add", "x.Order"]
    assert [tuple(r) for r in lookup.tests_per_file(tests, symbols).collect()] == [("shop/cart/add_test.py", 1)]
    assert [tuple(r) for r in lookup.by_hop(found).collect()] == [(1, 2, ["shop/cart.TestAdd", "x.Order"]), (2, 1, ["shop/cart.Add"])]
    assert tuple(lookup.point(found, "node", "none", {"hops": 0}).first()) == ("none", 0)
    cover = spark.createDataFrame([("t2", "s", 0.1), ("t1", "s", 0.9), ("t3", "s", 0.09), ("t1", "u", 1.0)], "test string, symbol string, fraction double")
    assert [r[0] for r in lookup.covering_tests(cover, "s").collect()] == ["t1", "t2"]
    e = spark.createDataFrame([("shop/cart.Add", "x.Order"), ("x.Order", "shop/cart.Add"), ("x.Order", "x.Order")], "src string, dst string")
    assert [tuple(r) for r in lookup.file_edges(e, symbols).collect()] == [("main.py", "shop/cart/add.py")]
    marks = spark.createDataFrame([(False,), (True,)], "marked boolean")
    assert lookup.has_markers(marks).first()[0] and not lookup.has_markers(marks.limit(0)).first()[0]


def test_replay(spark):
    c = spark.createDataFrame([(0, "a", None), (1, "b", "a"), (2, "a", None), (3, "c", "b"), (4, "d", "zz")], "pos int, path string, renamed string")
    assert sorted(r[0] for r in replay.files_as_of(c).collect()) == ["a", "c", "d"]
    assert sorted(r[0] for r in replay.files_as_of(c, 2).collect()) == ["b"]
    there = spark.createDataFrame([(1, "a"), (1, "k"), (2, "a")], "case int, path string")
    moves = spark.createDataFrame([(1, 0, "a", "b"), (1, 1, "b", "c"), (1, 2, "q", "k"), (2, 0, "a", "z"), (3, 0, "a", "b")], "case int, pos int, old string, new string")
    assert sorted(map(tuple, replay.origins(there, moves).collect())) == [(1, "c", "a"), (1, "k", "k"), (2, "z", "a")]
    t = spark.createDataFrame([(1, "a", True), (1, "a", True), (1, "b", True), (2, "a", True), (2, "b", False)], "case int, item string, corrective boolean")
    assert sorted(map(tuple, replay.targets(t, "corrected").collect())) == [(1, "a"), (1, "b")]
    assert replay.targets(t, "touched").count() == 4 and replay.targets(t, "symbols").count() == 0


def test_commit_log(spark, tmp_path):
    root = str(tmp_path / "r")
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=Bo", "-c", "user.email=bo@y", *a], check=True, capture_output=True)
    (tmp_path / "r").mkdir()
    assert not facts.is_repository(root)
    git("init", "-q")
    for name, text in (("one.py", "a\nb\n"), ("two.py", "c\n")):
        (tmp_path / "r" / name).write_text(text)
        git("add", ".")
        git("commit", "-qm", f"add {name}")
    facts.register(spark)
    commits, files = gitlog.parse_log(spark.read.format("commit_log").option("roots", root).load())
    assert commits.count() == 2 and sorted((r["path"], r["added"]) for r in files.collect()) == [("one.py", 2), ("two.py", 1)]
    assert facts.is_repository(root) and len(facts.head(root)) == 40
    assert facts.file_at(root, "HEAD", "two.py") == "c\n" and facts.file_at(root, "HEAD", "none") is None


def test_registry(spark):
    class Python:
        name = "python"

        def detect(self, root):
            return root == "p"

        def facts(self, spark, root):
            return {}

    known = facts.Registry(Python())
    assert known.select("p").name == known.select("q", "python").name == "python"
    for wrong in (("q",), ("p", "c")):
        with pytest.raises(LookupError):
            known.select(*wrong)
    p = spark.createDataFrame([(True,), (False,), (False,), (False,)], "failed boolean")
    assert tuple(facts.load_health(p).first()) == (4, 1, 0.25, True) and facts.load_health(p.limit(0)).first()["degradation"] == 1.0


@pytest.mark.parametrize("fixes,on,base,lift,want", [(14, 9, 0.5, 2.0, "too few fixes"), (15, 4, 0.5, 2.0, "too few hits"), (15, 5, 0.0, None, "never touched"), (20, 9, 0.5, 1.5, "strong"), (20, 9, 0.5, 1.1, "none"), (20, 9, 0.5, 1.11, "modest"), (20, 9, 0.5, 0.9, "none"), (20, 9, 0.5, 0.89, "opposite")])
def test_lift_verdict(spark, fixes, on, base, lift, want):
    row = spark.createDataFrame([(fixes, on, base, lift)], "fixes int, fixes_on int, base double, lift double")
    assert row.select(backtest.lift_verdict()).first()[0] == want


@pytest.mark.parametrize("own,other,bands,want", [
    (0.5, 0.4, [(0.1, 0.2, 2.0)], "leads overall"), (0.4, 0.4, [(0.3, 0.2, 2.0), (0.3, 0.2, 9.0)], "trails overall, wins every band"),
    (0.3, 0.4, [(0.20, 0.21, 4.0), (0.2, 0.9, 5.0)], "adds nothing over size"), (0.3, 0.4, [(0.2, 0.3, 2.0)], "trails in every band"), (0.3, 0.4, [(0.2, 0.2, 0.0)], "trails in every band"),
    (0.3, 0.4, [(0.3, 0.2, 2.0), (0.1, 0.3, 2.0)], "trails by the margin"), (0.3, 0.4, [(0.3, 0.2, 2.0), (0.1, 0.2, 2.0)], "mixed"), (0.3, 0.4, [], "no band could be scored"),
])
def test_strata_reading(spark, own, other, bands, want):
    overall = spark.createDataFrame([("a", own), ("b", other)], "strategy string, precision double")
    rows = [(s, k, p, 5, x[2]) for k, x in enumerate(bands) for s, p in (("a", x[0]), ("b", x[1]))]
    table = spark.createDataFrame(rows, "strategy string, band int, precision double, cases int, spread double")
    assert backtest.read_strata(overall, table, "a", "b").first()["reading"] == want


def test_contributions(spark):
    s = spark.createDataFrame([("all", 0.4, 0.5), ("-x", 0.3, 0.6), ("-y", 0.45, 0.5)], "strategy string, precision double, matched double")
    v = spark.createDataFrame([("x", "-x"), ("y", "-y"), ("z", "-z")], "signal string, strategy string")
    got = {r["signal"]: (round(r["precision_gain"], 6), round(r["matched_gain"], 6), r["harmful"]) for r in backtest.contributions(s, v, "all").collect()}
    assert got == {"x": (0.1, -0.1, False), "y": (-0.05, 0.0, True)}
    assert set(backtest.ablation_weights(ranking.WEIGHTS)) == {"", *ranking.WEIGHTS} - {"task_proximity"}


def test_questions(spark):
    a = spark.createDataFrame([(1, " 2 "), (2, "skip"), (3, "9"), (4, "1"), (5, "x")], "id int, answer string")
    a = a.select("id", probes.choice(F.col("answer"), 3).alias("choice"), F.array(F.lit("p"), F.lit("q"), F.lit("r")).alias("labels"), F.lit(1).alias("right"), F.lit("seen").alias("provenance"))
    got = {r["id"]: (r["outcome"], r["explanation"]) for r in probes.grade_choice(a).collect()}
    assert got == {1: ("correct", "seen"), 2: ("skipped", None), 3: ("skipped", None), 4: ("incorrect", "right is q: seen"), 5: ("skipped", None)}
    many = list("abcdefgh")
    g = spark.createDataFrame([(1, many, many, 0), (2, many, many, 1), (3, many, [], 2), (4, ["a", "b"], ["a"], 0)], "id int, expected array<string>, named array<string>, spurious int").withColumn("provenance", F.lit("graph"))
    text = {r["id"]: r["explanation"] for r in probes.explain_blast(g).collect()}
    assert text == {1: "all 8 dependents (graph)", 2: "all that breaks, and 1 thing that does not", 3: "right are a, b, c, d, e, f, and 2 more (graph)", 4: "not named: b (graph)"}
    log = spark.createDataFrame([("a", NOW - timedelta(hours=h)) for h in (1, 2)] + [("b", NOW - timedelta(days=8))], "symbol string, asked_at timestamp")
    now = F.lit(NOW)
    assert probes.allowed(log, now) and not probes.allowed(log, now, 2) and probes.allowed(log, now, 2, requested=True)
    c = spark.createDataFrame([("a", False, 0), ("b", False, 1), ("t", True, 2)], "symbol string, is_test boolean, pos int")
    assert [r["symbol"] for r in probes.may_fire(log, c, now).collect()] == ["b"] and probes.may_fire(log, c, now, 2).count() == 0
    met = spark.createDataFrame([("a",)], "symbol string")
    assert [r[0] for r in probes.first_edits(c, met, log, now).orderBy("symbol").collect()] == ["b", "t"]
    asks = lambda *s: spark.createDataFrame([(x,) for x in s], "symbol string")
    assert tuple(probes.next_question(c, ("blast", asks("b")), ("locate", asks("a", "b"))).first()) == ("a", "locate")
    assert [r[0] for r in probes.asked_since(log, now - F.expr("INTERVAL 1 DAY")).collect()] == ["a", "a"]


def test_same_directory_without_packages(spark):
    found = spark.createDataFrame([("d/a", "d/b", 3, 0.5), ("d/a", "e/c", 3, 0.5)], "a string, b string, together int, strength double")
    files = spark.createDataFrame([("d/a", "")], "path string, package string")
    none, edges = spark.createDataFrame([], "from_pkg string, to_pkg string"), spark.createDataFrame([], "src string, dst string")
    assert [r["b"] for r in coupling.hidden(found, edges, files, none).collect()] == ["e/c"]
    assert [r["partner"] for r in coupling.hidden_for(found, "e/c").collect()] == ["d/a"] and coupling.top_pairs(found, 1).first()["b"] == "d/b"


def test_texts_and_numbers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(scalar.first_doc_line(F.lit("short\nrest"))) == "short"
    assert one(scalar.first_doc_line(F.lit("aé漢x"), 5)) == "aé…" and one(scalar.first_doc_line(F.lit("abcdef"), 3)) == "abc…"
    assert one(scalar.tier_label(F.lit(3))) == "when you get to it" and one(scalar.agrees(F.lit(2), "does", "do")) == "do"
    rows = spark.createDataFrame([(f"k{i}", i % 5) for i in range(50)], "item string, size int")
    places = backtest.numbered(rows, [F.col("size"), F.col("item")], "place")
    want = sorted(((i % 5, f"k{i}") for i in range(50)))
    assert [(r["size"], r["item"]) for r in places.orderBy("place").collect()] == want and sorted(r["place"] for r in places.collect()) == list(range(1, 51))
