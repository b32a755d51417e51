"""Streams of documents: the checkpoint is what a reader resumes from."""

from __future__ import annotations

import urllib.parse

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import pretokens
from weft.sources import corpus


def documents(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def chunk_totals(docs: DataFrame, key: str, text: str, pattern: str = "isolating") -> DataFrame:
    """Running documents, characters and pre-tokens of each key."""
    return docs.groupBy(key).agg(F.count("*").alias("n_docs"), F.sum(F.length(text)).alias("n_chars"), F.sum(F.size(pretokens(F.col(text), pattern))).alias("n_chunks"))


def start(df: DataFrame, name: str, checkpoint: str, mode: str = "complete"):
    """To an in-memory table; the checkpoint folder holds the resume state."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_results(df: DataFrame, folder: str, checkpoint: str):
    """Results of a stream as they come, appended as Parquet; what a restarted stream has written already isn't written again."""
    return df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def _opened(path: str) -> pyarrow.parquet.ParquetFile:
    """A Parquet file by the path that Spark gives it, in any store that Arrow knows."""
    if path.startswith("file:"):
        path = "file:///" + urllib.parse.quote(path.removeprefix("file:").lstrip("/"))
    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.parquet.ParquetFile(fs.open_input_file(at))


def endless(spark: SparkSession, folder: str, rank: int = 0, world: int = 1, groups_per_batch: int = 8, after: tuple[int, str, int] | None = None, text: str = "text", rows: int = 128, only: list[str] | None = None) -> DataFrame:
    """A stream of (epoch, file, group, n, texts) that never ends: a rank's row groups, file by file, epoch after epoch.

    A rank reads the groups rank, rank + world, ... of each file; epochs start at 1. A micro-batch takes the next
    `groups_per_batch` groups, each read by one task, in batches of at most `rows` texts; n is the batch's place in its
    group. The stream's checkpoint holds the position: a stream that is started again goes on behind what its last one
    finished. `after` (epoch, file, group) is where a stream without a checkpoint goes on. `only` names the files to
    read; the list of row groups is taken from their footers when the stream is made. Without any it is an error.
    """
    listed = corpus.row_groups(spark, folder).where(F.col("group") % world == rank)
    listed = listed if only is None else listed.where(F.col("file").isin(only))
    mine = [(r["file"], r["group"]) for r in listed.orderBy("file", "group").collect()]  # a row for each group, no data
    if not mine:
        raise ValueError(f"rank {rank} of {world} has no row groups in {folder}")
    where = {name: path.toString() for name, path in corpus._listed(spark, folder)}
    first = 0
    if after is not None:
        epoch, file, group = after
        first = (epoch - 1) * len(mine) + sum(1 for x in mine if x <= (file, group))

    def read(batches):
        for b in batches:
            for number in b.column(0).to_pylist():
                epoch, at = divmod(first + number, len(mine))
                file, group = mine[at]
                with _opened(where[file]) as f:
                    column = f.read_row_group(group, columns=[text]).column(0).combine_chunks().cast(pa.string())
                for n, start in enumerate(range(0, max(1, len(column)), rows)):
                    texts = pa.ListArray.from_arrays(pa.array([0, len(column.slice(start, rows))], pa.int32()), column.slice(start, rows))
                    yield pa.RecordBatch.from_arrays([pa.array([epoch + 1], pa.int64()), pa.array([file]), pa.array([group], pa.int64()), pa.array([n], pa.int64()), texts], names=["epoch", "file", "group", "n", "texts"])

    # Numbers from 0 on, the same ones after a restart: what is counted here are row groups, not time.
    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", groups_per_batch).option("numPartitions", groups_per_batch).load()
    return clock.select("value").mapInArrow(read, "epoch long, file string, group long, n long, texts array<string>")
