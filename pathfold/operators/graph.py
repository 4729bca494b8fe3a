"""Graph operators over edge tables (src, dst); an edge points at what src depends on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathfold.parts import deal, parts
from pathfold.scratch import Scratch

DAMPING, MOST_ROUNDS, TOLERANCE = 0.85, 100, 1e-8
#: Ends in one row of a node's edges, about.
LIST = 4096


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def dedup(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def nodes_of(edges: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """node: both ends of every edge, and the isolated symbols."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return (ends.unionAll(symbols.select("node")) if symbols is not None else ends).distinct()


def subgraph(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends in keep (node)."""
    return edges.join(keep.select(F.col("node").alias("src")), "src", "left_semi").join(keep.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_in, n_out; parallel edges count each."""
    both = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(edges.select("dst", F.lit(1), F.lit(0)))
    return both.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def direct_dependents(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("dependents"))


def reachable(edges: DataFrame, seeds: DataFrame, most: int = 0) -> DataFrame:
    """node, hops: least hops from any seed, seeds at 0; most <= 0: without bound.

    Each step joins the frontier only and leaves out what was seen; the step's table cuts
    the lineage. Repeated edges do no harm, so they are not sorted out first.
    """
    scratch = Scratch(edges.sparkSession, "bfs")
    e = scratch.write(edges.select("src", "dst"), "edges")
    seen = scratch.write(seeds.select("node").distinct().withColumn("hops", F.lit(0)), "step0")
    frontier, step = seen, 0
    while not frontier.isEmpty() and (most <= 0 or step < most):
        step += 1
        new = e.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = scratch.write(new.join(seen, "node", "left_anti").withColumn("hops", F.lit(step)), f"step{step}")
        seen = seen.unionAll(frontier)
    return seen


def dependents(edges: DataFrame, seeds: DataFrame, most: int = 0) -> DataFrame:
    """What depends on the seeds, without them."""
    return reachable(reverse(edges), seeds, most).filter("hops > 0")


def dependencies(edges: DataFrame, seeds: DataFrame, most: int = 0) -> DataFrame:
    return reachable(edges, seeds, most).filter("hops > 0")


def proximity(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Hops in either direction; nodes out of reach have no row."""
    return reachable(edges.select("src", "dst").unionAll(reverse(edges)), seeds)


def blast_radius(static_edges: DataFrame, seeds: DataFrame, tests: DataFrame, most: int = 2) -> DataFrame:
    """Dependents by static calls; tests leave the result, but paths may pass through them."""
    return dependents(static_edges, seeds, most).join(tests.select("node"), "node", "left_anti")


def outgoing(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """src, n, dsts: the distinct ends of each node's edges and how many these are, in lists of
    about LIST, as a table in buckets of src that no join on src moves."""
    given = scratch.write(edges.select("src", "dst"), "given")
    rows = given.count()
    e = deal(given, rows, "src").distinct()
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    piece = F.expr(f"pmod(xxhash64(dst), n div {LIST} + 1)").alias("piece")
    lists = e.join(out, "src").groupBy("src", "n", piece).agg(F.array_sort(F.collect_list("dst")).alias("dsts")).select("src", "n", "dsts")
    out = scratch.write_buckets(lists, "edges", parts(edges.sparkSession, rows), "src")
    scratch.drop("given")
    return out


def pagerank(edges: DataFrame, nodes: DataFrame, teleport: DataFrame | None = None, rounds: int = MOST_ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """node, rank; ranks sum to 1. teleport: node, weight (negatives count as 0; without any
    positive weight on a known node it is uniform). Dangling mass follows the teleport."""
    scratch = Scratch(edges.sparkSession, "pagerank")
    e = outgoing(edges, scratch)
    n = nodes.select("node").distinct()
    t = n.withColumn("w", F.lit(0.0))
    if teleport is not None:
        given = teleport.groupBy("node").agg(F.sum(F.greatest(F.col("weight").cast("double"), F.lit(0.0))).alias("g"))
        t = n.join(given, "node", "left").select("node", F.coalesce("g", F.lit(0.0)).alias("w"))
    totals = t.agg(F.sum("w").alias("s"), F.count(F.lit(1)).alias("k")).first()
    if not totals["k"]:
        return n.withColumn("rank", F.lit(0.0))
    share = F.col("w") / totals["s"] if totals["s"] else F.lit(1.0 / totals["k"])
    dangling = ~F.coalesce("has_out", F.lit(False))
    base = t.join(e.select(F.col("src").alias("node"), F.lit(True).alias("has_out")).distinct(), "node", "left").select("node", share.alias("t"), dangling.alias("dangling"))
    base = scratch.write(base, "base")
    ranks = scratch.write(base.select("node", "t", "dangling", F.col("t").alias("rank")), "rank0")
    for k in range(1, rounds + 1):
        loose = ranks.filter("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        flow = e.join(ranks.select(F.col("node").alias("src"), "rank"), "src").select(F.explode("dsts").alias("node"), (F.col("rank") / F.col("n")).alias("part")).groupBy("node").agg(F.sum("part").alias("flow"))
        new = ranks.withColumnRenamed("rank", "old").join(flow, "node", "left")
        value = (1 - DAMPING) * F.col("t") + DAMPING * (F.coalesce("flow", F.lit(0.0)) + loose * F.col("t"))
        new = scratch.write(new.select("node", "t", "dangling", value.alias("rank"), F.abs(value - F.col("old")).alias("change")), f"rank{k}")
        change = new.agg(F.sum("change")).first()[0]
        scratch.drop(f"rank{k - 1}")
        ranks = new.select("node", "t", "dangling", "rank")
        if change < tolerance:
            break
    return ranks.select("node", "rank")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, comp: strongly connected components, named by their greatest node.

    Rounds of colouring: each live node takes the greatest node that reaches it; what of a
    colour reaches its namesake backwards is a component and leaves.
    """
    scratch = Scratch(edges.sparkSession, "scc")
    left = scratch.write(nodes.select("node").distinct(), "nodes0")
    e = scratch.write(dedup(edges).filter("src <> dst"), "edges0")
    done, k = left.limit(0).withColumn("comp", F.col("node")), 0
    while not left.isEmpty():
        k += 1
        busy = e.select(F.col("src").alias("node")).intersect(e.select(F.col("dst").alias("node")))
        alone = scratch.write(left.join(busy, "node", "left_anti").withColumn("comp", F.col("node")), f"alone{k}")
        if alone.isEmpty():
            colour, j = left.withColumn("c", F.col("node")), 0
            while True:
                j += 1
                best = e.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("c").alias("m"))
                new = scratch.write(colour.join(best, "node", "left").select("node", F.col("c").alias("old"), F.greatest("c", F.coalesce("m", "c")).alias("c")), f"colour{k}-{j}")
                colour = new.select("node", "c")
                if new.filter("old <> c").isEmpty():
                    break
            same = e.join(colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst").filter("cs = cd")
            back = reachable(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colour.filter("node = c").select("node"))
            alone = scratch.write(back.select("node").join(colour, "node").select("node", F.col("c").alias("comp")), f"found{k}")
        done = done.unionAll(alone)
        left = scratch.write(left.join(alone, "node", "left_anti"), f"nodes{k}")
        e = scratch.write(subgraph(e, left), f"edges{k}")
    return done


def dependency_depth(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """node, depth: the longest path beneath, in component hops; members share, leaves are 0.

    The condensation has no cycle, so peeling leaves ends; a component's depth is the round
    in which its last dependency has left.
    """
    scratch = Scratch(edges.sparkSession, "depth")
    of = lambda side: comps.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}"))
    e = edges.join(of("src"), "src").join(of("dst"), "dst").filter("csrc <> cdst").select(F.col("csrc").alias("src"), F.col("cdst").alias("dst")).distinct()
    e = scratch.write(e, "edges0")
    left = scratch.write(comps.select("comp").distinct(), "left0")
    found, k = left.limit(0).withColumn("depth", F.lit(0)), 0
    while not left.isEmpty():
        leaves = scratch.write(left.join(e.select(F.col("src").alias("comp")), "comp", "left_anti").withColumn("depth", F.lit(k)), f"leaves{k}")
        found = found.unionAll(leaves)
        k += 1
        left = scratch.write(left.join(leaves, "comp", "left_anti"), f"left{k}")
        e = scratch.write(e.join(leaves.select(F.col("comp").alias("dst")), "dst", "left_anti"), f"edges{k}")
    return comps.join(found, "comp").select("node", "depth")


def topological_order(depth: DataFrame) -> DataFrame:
    return depth.orderBy("depth", "node")
