"""Tables are dealt by their size, so that what a task holds doesn't grow with them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from pathfold import parts
from pathfold.operators import coupling
from pathfold.sources.binding import View

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["commit_files", "symbols", "call_sites", "edges"])
def test_views_are_dealt_by_the_size_of_the_table(spark, monkeypatch, name):
    monkeypatch.setattr(parts, "PER_TASK", 200)
    used = getattr(View(spark, DATA), name).groupBy(F.spark_partition_id()).count().agg(F.count(F.lit(1)), F.max("count")).first()
    assert used[0] > 20 and used[1] <= 1000


def test_pairs_of_changes_that_are_not_dealt(spark):
    rows = [(h, p) for h in range(60) for p in {h % 7, h % 5 + 3, h % 3 + 8, 50 + h % 2}] + [(100, p) for p in range(30)]
    con = duckdb.connect()
    con.sql("CREATE TABLE c (hash INT, path INT)")
    con.executemany("INSERT INTO c VALUES (?, ?)", rows)
    want = con.sql("""WITH s AS (SELECT hash FROM c GROUP BY hash HAVING count(*) BETWEEN 2 AND 20), n AS (SELECT path, count(*) AS n FROM c GROUP BY path)
      SELECT a, b, together, round(together / (na.n + nb.n - together), 9) FROM (SELECT x.path AS a, y.path AS b, count(*) AS together FROM c x JOIN c y ON x.hash = y.hash AND x.path < y.path
      WHERE x.hash IN (FROM s) AND (x.path < 9 OR y.path < 9) GROUP BY ALL HAVING count(*) >= 3) JOIN n na ON na.path = a JOIN n nb ON nb.path = b""").fetchall()
    changes = spark.createDataFrame(rows + rows[:20], "hash int, path int")
    got = coupling.pairs(changes, spark.range(9).select(F.col("id").cast("int").alias("path")))
    assert sorted((r.a, r.b, r.together, round(r.strength, 9)) for r in got.collect()) == sorted(want) and want
