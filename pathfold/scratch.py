"""Intermediate tables in the folder that the cluster shares (spark.checkpoint.dir).

A written table cuts lineage and survives the loss of any executor. The folder is
read from the session; only a local session without the setting gets a temporary one.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: So long events are awaited at most.
EVENTS_MS = 10_000
#: Between two collections, for the cleaner to act on the first.
PAUSE_S = 0.5
_LOCAL_ROOT: list[str] = []
_OPEN: list[Scratch] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder; on a cluster without spark.checkpoint.dir this raises."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append("file://" + tempfile.mkdtemp(prefix="pathfold-"))
    return _LOCAL_ROOT[0]


class Scratch:
    """A folder of its own for the intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/pathfold/{name}-{uuid.uuid4().hex}"
        self.tables: list[str] = []
        _OPEN.append(self)

    def write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write df as a table, with a folder for each value of `by`, and return it reread."""
        (df.write.partitionBy(by) if by else df.write).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def write_buckets(self, df: DataFrame, name: str, n: int, key: str) -> DataFrame:
        """As write, for df dealt by key in n partitions: joins on key leave these rows in place."""
        table = f"{self.path.rsplit('/', 1)[-1]}_{name}".replace("-", "_")
        df.write.bucketBy(n, key).option("path", f"{self.path}/{name}").saveAsTable(table, format="parquet")
        self.tables.append(table)
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            self._delete(f"{self.path}/{name}")

    def close(self) -> None:
        while self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop()}")
        self._delete(self.path)
        if self in _OPEN:
            _OPEN.remove(self)

    def _delete(self, path: str) -> None:
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def opened() -> list[Scratch]:
    """The folders that are not closed, oldest first."""
    return list(_OPEN)


@atexit.register
def _close_all() -> None:
    for scratch in opened():
        with contextlib.suppress(Exception):
            scratch.close()


def free_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner remove shuffle files of plans that are no longer referenced.
    Events that wait for their listeners still hold plans, so they are awaited first."""
    import gc

    gc.collect()
    with contextlib.suppress(Exception):  # only a later collection frees the files then
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(EVENTS_MS)
    spark._jvm.System.gc()
    time.sleep(PAUSE_S)
    spark._jvm.System.gc()  # the first leaves some of the latest plan
