"""The personalized PageRank runs until it converges."""

from pathfold.operators import graph
from pathfold.plans import queries


def test_personalized_pagerank_keeps_the_default_rounds(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(graph, "pagerank", lambda e, nodes, teleport=None, rounds=graph.MOST_ROUNDS, tolerance=graph.TOLERANCE: asked.append((rounds, tolerance)) or nodes.selectExpr("node", "0D AS rank"))
    queries.QUERIES["personalized_pagerank"](spark, "/root/testdata/sf0.001")
    assert asked == [(100, 1e-8)]
