"""Composite score and path of all six signals against a plain computation."""

from bisect import bisect_left, bisect_right

from pathfold.operators import ranking
from pathfold.plans import queries
from pathfold.sources.binding import View

DATA = "/root/testdata/sf0.001"
SIGNALS = {"centrality": ("pagerank", "node", "rank"), "churn": ("churn", "path", "churn"), "hidden_coupling": ("hidden_coupling", "path", "coupling"), "fix_density": ("fix_density", "path", "fix_density"), "orphaning": ("orphaning", "path", "orphaning"), "ai_density": ("ai_density", "path", "ai_density")}


def test_score_and_path_of_all_signals(spark):
    symbols = {r["symbol"]: r for r in View(spark, DATA).symbols.collect()}
    want, total, live = dict.fromkeys(symbols, 0.0), 0.0, set()
    for signal, (name, key, value) in SIGNALS.items():
        raw = {r[key]: r[value] for r in queries.QUERIES[name](spark, DATA).collect() if r[value] and r[value] > 0}
        mine = {s: raw[r["path"]] for s, r in symbols.items() if r["path"] in raw and not (signal == "centrality" and r["is_test"])}
        if not mine:
            continue
        live.add(signal)
        total += ranking.WEIGHTS[signal]
        order = sorted(mine.values())
        for s, x in mine.items():
            lo, hi = bisect_left(order, x), bisect_right(order, x)
            want[s] += ranking.WEIGHTS[signal] * ((lo + (hi - lo - 1) / 2) / (len(order) - 1) if len(order) > 1 else 1.0)
    assert {"centrality", "churn", "fix_density", "orphaning", "ai_density"} <= live
    want = {s: x / total for s, x in want.items() if not symbols[s]["is_test"] and not symbols[s]["generated"]}
    got = {r["symbol"]: r["score"] for r in queries.QUERIES["composite_score_all"](spark, DATA).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 2e-6 for s in want)
    depth = {r["node"]: r["depth"] for r in queries.QUERIES["dependency_depth_calls"](spark, DATA).collect()}
    top = sorted((s for s in got if got[s] > 0), key=lambda s: (-got[s], s))[:40]
    tier = lambda s: 1 if got[s] >= 0.7 * got[top[0]] else 2 if got[s] >= 0.4 * got[top[0]] else 3
    rows = [(tier(s), depth.get(symbols[s]["path"], 0), -got[s], s) for s in top]
    path = [(r["tier"], r["depth"], -r["score"], r["symbol"]) for r in queries.QUERIES["reading_path_all"](spark, DATA).collect()]
    assert path == sorted(rows)
