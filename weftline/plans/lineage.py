"""Cutting lineage through tables in the shared checkpoint folder.

A written table survives the loss of any executor, is computed once (``DataFrame.checkpoint``
computes its input twice) and can be dropped as soon as the next round has been written.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; one of our own only where unset, and then only in local mode."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not folder:
        master = spark.sparkContext.master or ""
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"{_SETTING} must name a folder that all executors of {master} share")
        own = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = "file://" + own
        spark.conf.set(_SETTING, folder)
    return folder.rstrip("/")


class Scratch:
    """Tables of one operator run under the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def cut(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back: same rows, no lineage."""
        self._n += 1
        path = f"{self.root}/{self._n:04d}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._weftline_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table made by ``cut`` that nothing reads any more."""
        path = getattr(df, "_weftline_path", None)
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
