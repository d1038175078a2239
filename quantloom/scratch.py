"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset (local tests) a temp folder is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="quantloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path


_roots: dict[str, SparkSession] = {}


def clear() -> None:
    """Remove every scratch table of this process; called at its end, and by tests when no result is read any more."""
    while _roots:
        root, spark = _roots.popitem()
        with contextlib.suppress(Exception):  # the session has ended: its folder goes with the cluster
            remove(spark, root)


atexit.register(clear)


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Writes DataFrames as Parquet tables to the shared folder and reads them back.

    A written table cuts lineage, survives lost executors and is read in columns.
    ``drop`` removes tables that no later plan reads; ``keep`` writes a result and
    removes every other table of this scratch. What is left goes when the process
    that made it ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        _roots[self.root] = spark
        self._n = 0
        self._live: set[str] = set()

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._live.add(path)
        out._scratch_path = path
        return out

    def keep(self, df: DataFrame, name: str = "result") -> DataFrame:
        out = self.table(df, name)
        for path in self._live - {out._scratch_path}:
            self.remove(path)
        self._live = {out._scratch_path}
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.remove(t._scratch_path)
            self._live.discard(t._scratch_path)

    def clean(self) -> None:
        """Remove every table of this scratch."""
        self._live.clear()
        self.remove(self.root)

    def remove(self, path: str) -> None:
        remove(self.spark, path)
