"""PageRank's edges stay in their buckets, files are ranked for their symbols, and two-hop
questions leave out early only what can't qualify."""

import random

from pyspark.sql import functions as F

from pathfold.operators import graph, probes, ranking
from pathfold.scratch import Scratch


def test_lists_of_ends_are_not_moved_by_a_join(spark, monkeypatch):
    monkeypatch.setattr(graph, "LIST", 4)
    rows = [(a, b) for a in range(20) for b in range(a)] + [(5, 1)] * 3
    e = graph.outgoing(spark.createDataFrame(rows, "src long, dst long"), Scratch(spark, "test"))
    got = e.collect()
    assert sorted((r.src, x) for r in got for x in r.dsts) == sorted(set(rows)) and all(r.n == r.src for r in got)
    assert max(len(r.dsts) for r in got) < 19
    found = e.join(spark.range(20).withColumnRenamed("id", "src").repartition(3).hint("merge"), "src")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(src") == 1 and found.count() == len(got)


def test_a_row_that_stands_for_several_ranks_as_they_do(spark):
    rows = [(k, float(k * 7 % 5), k % 4 + 1) for k in range(40)]
    files = spark.createDataFrame(rows, "key int, x double, k int")
    single = files.select("key", "x", F.explode(F.sequence(F.lit(1), "k")))
    want = {(r.key, round(r.rank, 12)) for r in ranking.percentile_rank(single, "key", "x", "rank").collect()}
    got = ranking.percentile_rank(files, "key", "x", "rank", times="k").collect()
    assert {(r.key, round(r.rank, 12)) for r in got} == want and len(got) == len(want)


def test_blast_questions_equal_brute_force(spark):
    rng = random.Random(3)
    edges = {(rng.randrange(120), rng.randrange(120)) for _ in range(160)} | {(k, 1) for k in range(30)} | {(1, 60), (60, 61), (62, 62)} | {(k, 2) for k in range(100, 114)} | {(2, 3), (3, 2)} | {(k, 4) for k in range(100, 113)} | {(4, 100), (4, 4)}
    tests = {k for k in range(120) if k % 6 == 0}
    cover = [(k, 1000 + j, 0.5) for k in (1, 2, 5, 60, 61, 119) for j in range(3)]
    into: dict[int, set] = {}
    for a, b in edges:
        into.setdefault(b, set()).add(a)
    want = {}
    for s in set(into) | {k for k, *_ in cover}:
        one = into.get(s, set())
        every = {x for x in one | {f for i in one for f in into.get(i, ())} if x not in tests} | {j for k, j, _ in cover if k == s}
        if 2 <= len(every - {s}) <= 12:
            want[s] = sorted(every - {s})
    e = spark.createDataFrame(sorted(edges) * 2, "src int, dst int")
    got = probes.blast_questions(e, spark.createDataFrame(cover, "symbol int, test int, fraction double"), spark.createDataFrame([(k,) for k in tests], "node int"))
    assert {r.symbol: r.expected for r in got.collect()} == want and len(want) > 5
