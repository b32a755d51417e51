"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
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


def spread(scan: DataFrame) -> DataFrame:
    """Rows of a plain scan over as many tasks as there are cores, where files come in fewer parts: one row group is one task else."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


#: Bytes of an Arrow batch where several Python workers follow one another: each holds one, and so does the JVM for each.
BATCH_BYTES = 8 << 20


def lean(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's 64 MB, unless the session has set them."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("64MB", str(64 << 20), f"{64 << 20}b"):
        spark.conf.set(name, str(BATCH_BYTES))


#: Elements of lists or bytes that a worker turns into Python objects at once.
AT_ONCE = 1 << 16


def slices(batches: Iterable[pa.RecordBatch], *columns: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices whose lists, texts or bytes in `columns` have at most AT_ONCE elements, or one row.

    A batch has as many rows as Spark gives it: what a worker holds as Python objects must not grow with that.
    """
    for b in batches:
        sizes = np.ones(b.num_rows, np.int64)
        for c in columns:
            x = b.column(c)
            n = pc.list_value_length(x) if pa.types.is_list(x.type) else pc.binary_length(x)
            sizes = sizes + pc.fill_null(n, 0).to_numpy(zero_copy_only=False)
        upto, at = np.cumsum(sizes), 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, "right")))
            yield b.slice(at, end - at)
            at = end


class Tables:
    """Tables that are written once and read many times, below the shared folder; removed when the program ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/weft-{name}-{uuid.uuid4().hex[:12]}"
        _MADE.append((spark, self.path))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """`df` as a written table: what comes after starts at its files, on whichever executors are left."""
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def remove(self) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        try:
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the JVM has gone already; its folders stay for the cluster's own cleaning
            return
