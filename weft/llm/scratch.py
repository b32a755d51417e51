"""Written tables that cut lineage, in the shared folder that the session names."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; a temporary folder only where it is unset and all runs in this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "weft-checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """A folder of its own under the shared one, removed when the program ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/weft-{name}-{uuid.uuid4().hex[:12]}"
        _MADE.append((spark, self.path))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df` and read it back: later plans start at the files, on whichever executors are left."""
        to = f"{self.path}/{name}"
        df.write.parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def drop(self, name: str) -> None:
        """Remove a table that nothing reads any more."""
        _remove(self.spark, f"{self.path}/{name}")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        try:
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                _remove(spark, path)
        except Exception:  # the JVM has gone already; its folders stay for the cluster's own cleaning
            return
