"""The log that parsed_commits writes has one line at each place, the header first."""

from pyspark.sql import functions as F

from pathfold.plans import more, queries  # noqa: F401  more adds to the registry
from pathfold.sources import gitlog


def test_no_file_line_shares_the_place_of_its_header(spark, monkeypatch):
    seen, parse = [], gitlog.parse_log
    monkeypatch.setattr(gitlog, "parse_log", lambda lines: seen.append(lines) or parse(lines))
    queries.QUERIES["parsed_commits"](spark, "/root/testdata/sf0.001")
    (lines,) = seen
    assert lines.filter("line LIKE '%\\tf0.c'").count() > 0  # part 0 is in the tables
    assert lines.groupBy("repo", "pos").count().filter("count > 1").count() == 0
    head = F.col("line").startswith("\x02")
    places = lines.groupBy("repo").agg(F.max(F.when(head, F.col("pos"))).alias("header"), F.min(F.when(~head, F.col("pos"))).alias("file"))
    assert places.filter("header IS NULL OR header >= file").count() == 0
