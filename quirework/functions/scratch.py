"""Intermediate tables in the folder that all executors share.

A saved table cuts lineage and survives the loss of executors: every reader
scans files, none depends on blocks that one executor holds.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_LIVE: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder where it is unset and driver and executor are one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quirework-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clear() -> None:
    for path, spark in list(_LIVE.items()):
        if spark.sparkContext._jsc is not None:
            # The session may be on its way out; the folder is the cluster's to clean then.
            with contextlib.suppress(Py4JError, OSError):
                _delete(spark, path)


class Scratch:
    """Tables of one operator run. ``drop`` as soon as no later plan reads a table."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        _LIVE[self.root] = spark

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes saved tables; others are left alone."""
        for df in tables:
            path = getattr(df, "_scratch_path", None)
            if path:
                _delete(self.spark, path)
