"""The counts of a range of keys are moved alone and go before the next range is moved."""

import numpy as np
from pyspark.sql import functions as F

from pathfold.llm import jaccard
from pathfold.scratch import Scratch


def test_items_are_made_range_by_range(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 3, 40))) for k in range(60)]
    scratch = Scratch(spark, "test")
    texts = scratch.write(spark.createDataFrame(rows, "id long, text string"), "texts")
    meta = scratch.write(texts.mapInArrow(jaccard._describe, "id long, n long, a long, b long"), "meta")
    sets = meta.filter("n > 0").groupBy("n", "a", "b").agg(F.min("id").alias("id"))
    events, write, drop = [], Scratch.write, Scratch.drop
    monkeypatch.setattr(jaccard, "PER_TASK", 700)
    monkeypatch.setattr(jaccard, "passes", lambda total, texts, buckets: 3)
    monkeypatch.setattr(Scratch, "write", lambda self, d, name, *a, **b: events.append(name) or write(self, d, name, *a, **b))
    monkeypatch.setattr(Scratch, "drop", lambda self, *names: events.append(names) or drop(self, *names))
    got = {r.id: {x % (1 << 64) for x in r.shared} for r in jaccard.items_of(texts, meta, sets, scratch).collect()}
    gone = [tuple(f"counted{j}/turn={k}" for j in range(3)) for k in range(3)]
    assert events == ["counted0", "counted1", "counted2", "items0", gone[0], "items1", gone[1], "items2", gone[2]]
    own = dict(enumerate(jaccard.shingle_sets(*jaccard.wordhash.flat(jaccard.pa.array([t for _, t in rows])))))
    several = {int(h) for h, c in zip(*np.unique(np.concatenate(list(own.values())), return_counts=True), strict=True) if c > 1}
    want = {k: {int(h) for h in s} & several for k, s in own.items()}
    assert got == {k: s for k, s in want.items() if 4 * len(s) >= 3 * len(own[k])} and len(got) > 20
