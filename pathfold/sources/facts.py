"""Where facts come from: the source protocol, its registry, and commit logs of repositories."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The record and field marks that sources.gitlog.parse_log reads.
LOG_FORMAT = "%x02%H%x1f%an%x1f%ae%x1f%at%x1f%s"


class FactSource(Protocol):
    """Makes the index tables of a repository: schemas.INDEX name to table."""

    name: str

    def detect(self, root: str) -> bool: ...

    def facts(self, spark: SparkSession, root: str) -> dict[str, DataFrame]: ...


class Registry:
    """Sources by name, tried in the order in which they were added."""

    def __init__(self, *sources: FactSource):
        self.sources: dict[str, FactSource] = {}
        for source in sources:
            self.add(source)

    def add(self, source: FactSource) -> None:
        if source.name in self.sources:
            raise ValueError(f"there is a source named {source.name}")
        self.sources[source.name] = source

    def select(self, root: str, name: str | None = None) -> FactSource:
        if name is not None:
            if name not in self.sources:
                raise LookupError(f"no source named {name}; there are {', '.join(self.sources) or 'none'}")
            return self.sources[name]
        for source in self.sources.values():
            if source.detect(root):
                return source
        raise LookupError(f"no source knows {root}")


def load_health(packages: DataFrame, most: float = 0.2) -> DataFrame:
    """loaded, failed, degradation, degraded. packages: failed. A share of failures above
    `most` discards the index; where nothing was loaded, the share is 1."""
    g = packages.agg(F.count(F.lit(1)).alias("loaded"), F.count_if("failed").alias("failed"))
    return g.withColumn("degradation", F.coalesce(F.col("failed") / F.nullif("loaded", F.lit(0)), F.lit(1.0))).withColumn("degraded", F.col("degradation") > most)


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, check=True, encoding="utf-8", errors="replace").stdout


def is_repository(root: str) -> bool:
    try:
        return _git(root, "rev-parse", "--is-inside-work-tree").strip() == "true"
    except (subprocess.CalledProcessError, OSError):
        return False


def head(root: str) -> str:
    return _git(root, "rev-parse", "HEAD").strip()


def file_at(root: str, revision: str, path: str) -> str | None:
    """The text of a file at a revision, or None where it has none."""
    try:
        return _git(root, "show", f"{revision}:{path}")
    except subprocess.CalledProcessError:
        return None


class CommitLog(DataSource):
    """spark.read.format("commit_log").option("roots", "/a,/b").load(): repo, pos, line of the
    logs, oldest commit first, without merges, renames detected. One partition a repository."""

    @classmethod
    def name(cls) -> str:
        return "commit_log"

    def schema(self) -> str:
        return "repo string, pos long, line string"

    def reader(self, schema) -> DataSourceReader:
        return _LogReader([r for r in self.options.get("roots", "").split(",") if r], self.options.get("revision", "HEAD"))


class _LogReader(DataSourceReader):
    def __init__(self, roots: list[str], revision: str):
        self.roots, self.revision = roots, revision

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(root) for root in self.roots]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        command = ["git", "-C", partition.value, "log", "--no-merges", "--reverse", "-M", "--numstat", f"--format={LOG_FORMAT}", self.revision]
        with subprocess.Popen(command, stdout=subprocess.PIPE, encoding="utf-8", errors="replace") as run:
            pos = 0
            for line in run.stdout:
                if line := line.rstrip("\n"):
                    yield partition.value, pos, line
                    pos += 1
        if run.returncode:
            raise RuntimeError(f"the log of {partition.value} can't be read")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CommitLog)
