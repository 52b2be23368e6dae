"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session has none and runs on this machine alone (tests, local
    mode) a temporary folder is used and removed at exit; a cluster without the
    setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = getattr(scratch_root, "local", None)
    if root is None:
        root = tempfile.mkdtemp(prefix="tidewatch-")
        scratch_root.local = root
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"file://{root}"


class Scratch:
    """Intermediate tables in the shared folder; they cut lineage and survive
    the loss of any executor.  What is not dropped before goes when the driver's
    file system closes, at the application's end."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/tidewatch-{uuid.uuid4().hex}"
        self.marked = False

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        if not self.marked:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(at)
            self.marked = True
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
