"""Readers of corpora, task files and tokenizer artifacts, and the writers that go with them."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def resolve_dir(given: str | None = None, default: str = "data/base", variable: str = "LOCAL_PARQUET_DIR") -> str:
    """The given folder, else the environment's, else the default."""
    return given or os.environ.get(variable) or default


def _listed(spark: SparkSession, folder: str) -> list[tuple[str, object]]:
    """(name, path) of the Parquet files of a folder, or of the one file that it is, in the order of names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(((x.getPath().getName(), x.getPath()) for x in fs.listStatus(at) if x.getPath().getName().endswith(".parquet")), key=lambda t: t[0])
    if not names:
        raise FileNotFoundError(f"no Parquet files in {folder}")
    return names


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """(file, place) of the Parquet files of a folder, from its listing; a missing or empty one is an error."""
    return spark.createDataFrame([(name, i) for i, (name, _) in enumerate(_listed(spark, folder))], "file string, place long")


def split(spark: SparkSession, folder: str | list[str], which: str, text: str = "text") -> DataFrame:
    """Rows of the training files (all but the last by name) or of the validation file, with file and row number.

    A list names the shards themselves: each is a file, or a folder whose parts are one shard and count their rows apart.
    """
    if which not in ("train", "val"):
        raise ValueError("split must be train or val")
    if not isinstance(folder, str):
        *first, last = sorted(folder, key=os.path.basename)
        if which == "train" and not first:
            raise ValueError("training needs at least two files")
        out = None
        for path in [last] if which == "val" else first:
            one = spark.read.parquet(path).select(text, F.lit(os.path.basename(path)).alias("file"), F.col("_metadata.row_index").alias("row"))
            out = one if out is None else out.union(one)
        return out
    rows = spark.read.parquet(folder).select(text, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    ends = shards(spark, folder).agg(F.min("file").alias("lo"), F.max("file").alias("hi")).first()
    if which == "train" and ends["lo"] == ends["hi"]:
        raise ValueError("training needs at least two files")
    # A literal file name prunes whole files in the scan.
    return rows.where(F.col("file") == ends["hi"]) if which == "val" else rows.where(F.col("file") != ends["hi"])


def row_groups(spark: SparkSession, folder: str) -> DataFrame:
    """(file, group, first, last) from the files' footers: no more of a file is read, wherever Spark's readers find it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name, path in _listed(spark, folder):
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf))
        try:
            at = 0
            for g, block in enumerate(reader.getFooter().getBlocks()):
                n = block.getRowCount()
                out.append((name, g, at, at + n - 1))
                at += n
        finally:
            reader.close()
    return spark.createDataFrame(out, "file string, group long, first long, last long")


def ranked(rows: DataFrame, groups: DataFrame, rank: int, world: int) -> DataFrame:
    """Rows of the row groups rank, rank + world, ... of each file."""
    mine = groups.where(F.col("group") % world == rank)
    return rows.join(mine, (rows["file"] == mine["file"]) & rows["row"].between(mine["first"], mine["last"])).drop(mine["file"])


def document_batches(rows: DataFrame, groups: DataFrame, rank: int, world: int, epochs: int = 1, resume: tuple[int, str, int] | None = None) -> DataFrame:
    """Rows of a rank's row groups over some epochs, with epoch and group; `resume` names the (epoch, file, group) after which it goes on.

    Epochs come in order, within one the files by name, within one its groups. Every epoch reads the same rows again: an epoch is a column of the plan, not a pass of the driver.
    """
    mine = ranked(rows, groups, rank, world).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    if resume is not None:
        epoch, file, group = resume
        later = (F.col("file") > file) | ((F.col("file") == file) & (F.col("group") > group))
        mine = mine.where((F.col("epoch") > epoch) | ((F.col("epoch") == epoch) & later))
    return mine


def jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """A file as one document."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def baselines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="task string, baseline double")


def merges(spark: SparkSession, path: str) -> DataFrame:
    """Merge rules: not the version line, no blank ones."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#version") & (F.trim("value") != ""))
    return lines.select(F.split("value", " ")[0].alias("left"), F.split("value", " ")[1].alias("right"))


def compositions(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a composition file; other versions than 1 are an error."""
    schema = "version int, num_modifier_groups int, modifier_group_sizes array<int>, default_modifier array<int>, group_names array<string>, entries array<struct<token_ids: array<int>, base_ids: array<int>, modifier_rows: array<array<int>>, modifier: array<int>, surface: string>>, inverse_entries array<struct<base_id: int, modifier: array<int>, surface: string>>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    checked = F.when(F.col("version") == 1, F.col("entries")).otherwise(F.raise_error(F.lit("composition files of version 1 only")))
    each = doc.select(F.explode(checked).alias("e"))
    rows = F.coalesce("e.modifier_rows", F.transform("e.base_ids", lambda _: F.col("e.modifier")))
    return each.select("e.token_ids", "e.base_ids", rows.alias("modifier_rows"), "e.surface")


def em_rows(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(context, continuation, answers) of rows in any of three shapes; blank answers go, a gold index out of range is an error."""
    gold = F.try_element_at("choices", F.col("gold") + 1)
    chosen = F.when(F.col("choices").isNotNull() & gold.isNull(), F.raise_error(F.lit("gold index out of range"))).otherwise(gold)
    answers = F.coalesce("answers", F.array(F.coalesce("answer", "continuation", chosen)))
    return rows.select(*keep, F.coalesce("context", "query").alias("context"), F.coalesce("continuation", F.lit("")).alias("continuation"), F.filter(answers, lambda a: F.trim(a) != "").alias("answers"))


def write_jsonl(df: DataFrame, text: str, path: str) -> None:
    df.select(F.col(text).alias("text")).write.mode("errorifexists").json(path)


def text_digest(df: DataFrame, order: str, text: str) -> str:
    """SHA-256 of all texts in order, a line feed after each: one ordered pass, streamed partition by partition."""
    out = hashlib.sha256()
    for row in df.select(order, text).orderBy(order).toLocalIterator(prefetchPartitions=True):
        out.update((row[text] or "").encode())
        out.update(b"\n")
    return out.hexdigest()
