"""The whole baselines rank every indexed file with a positive value."""

import pytest

from pathfold.operators import history
from pathfold.plans import queries
from pathfold.sources.binding import View

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["churned", "recent", "authors", "largest"])
def test_whole_ranking(spark, name):
    v = View(spark, DATA)
    rows = queries.QUERIES[f"baseline_{name}_all"](spark, DATA).collect()
    indexed = {r["path"] for r in v.symbols.filter("NOT is_test").select("path").distinct().collect()}
    changed = {r["path"] for r in v.windowed(queries.WINDOW_DAYS).join(v.commit_files, "hash").select("path").distinct().collect()}
    want = indexed & changed if name in ("churned", "authors") else indexed
    assert {r["path"] for r in rows} == want and len(rows) == len(want) > 50
    rows.sort(key=lambda r: r["pos"])
    assert [r["pos"] for r in rows] == list(range(1, len(rows) + 1))
    assert rows == sorted(rows, key=lambda r: (-r["value"], r["path"]))
    if name == "largest":
        assert {r["path"]: r["value"] for r in rows} == {r["path"]: r["value"] for r in history.largest_files(v.symbols).collect()}
