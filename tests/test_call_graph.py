"""Questions and depth over the call graph against brute force."""

from functools import cache

from pathfold.operators import graph, probes
from pathfold.plans import queries
from pathfold.sources.binding import View

DATA = "/root/testdata/sf0.001"


def brute_depth(edges):
    """Longest path over components; a node's component is all that it reaches and is reached by."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
        after.setdefault(b, set())

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for b in after[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        return seen

    far = {a: reach(a) for a in after}
    comp = {a: min([a, *(b for b in far[a] if a in far[b])]) for a in after}
    below = {c: {comp[b] for a in after if comp[a] == c for b in after[a]} - {c} for c in set(comp.values())}
    depth = cache(lambda c: max((depth(x) + 1 for x in below[c]), default=0))
    return {a: depth(comp[a]) for a in after}


def brute_questions(edges, tests):
    before = {}
    for a, b in edges:
        before.setdefault(b, set()).add(a)
    out = {}
    for s, one in before.items():
        every = one.union(*(before.get(x, set()) for x in one)) - {s} - tests
        if 2 <= len(every) <= 12:
            out[s] = sorted(every)
    return out


def test_depth_with_cycles(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (7, 1), (8, 6), (9, 8), (9, 7)]
    e = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["depth"] for r in graph.dependency_depth(e, graph.components(e, graph.nodes_of(e))).collect()}
    assert got == brute_depth(edges) and got[9] == 4


def test_depth_and_order_of_calls(spark):
    edges = [tuple(r) for r in View(spark, DATA).edges.collect()]
    rows = [(r["depth"], r["node"]) for r in queries.QUERIES["topological_order_calls"](spark, DATA).collect()]
    assert rows == sorted(rows) and {n: k for k, n in rows} == brute_depth(edges)


def test_questions_of_calls(spark):
    v = View(spark, DATA)
    edges = {(r["src"], r["dst"]) for r in v.call_sites.filter("static").collect()}
    tests = {r["path"] for r in v.files.filter("is_test").collect()}
    got = {r["symbol"]: [int(x) for x in r["expected"].split(",")] for r in queries.QUERIES["blast_questions_calls"](spark, DATA).collect()}
    assert got == brute_questions(edges, tests)
    small = [(2, 1), (3, 2), (4, 3), (5, 1), (1, 5), (6, 9)]
    df = spark.createDataFrame(small, "src long, dst long")
    node = spark.createDataFrame([(2,)], "node long")
    got = {r["symbol"]: r["expected"] for r in probes.blast_questions(df, tests=node).collect()}
    assert got == brute_questions(small, {2})
