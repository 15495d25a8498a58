"""Durable state between Spark jobs.

A sampling loop cuts its lineage by writing each new state as a parquet table in
shared storage and reading it back: one computation per state, columnar and
prunable on the next read, and it outlives any executor.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """Folder for loop state: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="latent-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly under ``path``; none if it doesn't exist."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return []
    return [s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory()]


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target.getFileSystem(conf).delete(target, True)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_depth: dict[str, tuple[int, str | None]] = {}


@contextmanager
def short_shuffles(spark: SparkSession):
    """Within, a query's shuffle files go when it ends, not when the driver's garbage is collected.

    For queries that run once. May be nested and used by several threads of a session: the
    setting goes back when the last one leaves.
    """
    session = spark._jsparkSession.sessionUUID()
    with _lock:
        n, before = _depth.get(session, (0, None))
        if not n:
            before = spark.conf.get(SHUFFLE_CLEANUP, None)
            spark.conf.set(SHUFFLE_CLEANUP, "true")
        _depth[session] = n + 1, before
    try:
        yield
    finally:
        with _lock:
            n, before = _depth.pop(session)
            if n > 1:
                _depth[session] = n - 1, before
            elif spark.sparkContext._jsc is not None:
                spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


class Workspace:
    """The tables one run writes; each is dropped once no later step can read it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_root(spark)}/latent-{uuid.uuid4().hex}"
        self._serial = 0
        self._written: set[str] = set()
        self._pinned: set[str] = set()
        atexit.register(self.close)

    def cut(self, df: DataFrame, name: str, pin: bool = False) -> DataFrame:
        """Materialise ``df`` and return a scan of the result."""
        self._serial += 1
        path = f"{self.path}/{self._serial:06d}-{name}"
        with short_shuffles(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        (self._pinned if pin else self._written).add(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._latent_path = path
        return table

    def split(self, df: DataFrame, name: str, by: str, n: int) -> list[DataFrame]:
        """Materialise ``df`` once and return a scan for each value 0…n−1 of column ``by``."""
        self._serial += 1
        path = f"{self.path}/{self._serial:06d}-{name}"
        with short_shuffles(self.spark):
            df.write.option("compression", "zstd").partitionBy(by).parquet(path)
        self._written.add(path)
        table = self.spark.read.schema(df.schema).option("basePath", path).parquet(path)
        parts = [table.where(F.col(by) == i).select(*df.columns) for i in range(n)]
        for part in parts:
            part._latent_path = path
        return parts

    def retain(self, frames) -> None:
        """Delete every unpinned table except those behind ``frames``."""
        live = {getattr(f, "_latent_path", None) for f in frames}
        for path in self._written - live:
            self._delete(path)
        self._written &= live

    def close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.path)
        except Exception:  # the JVM may already be gone at interpreter exit
            pass

    def _delete(self, path: str) -> None:
        delete(self.spark, path)
