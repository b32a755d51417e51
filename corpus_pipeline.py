"""From raw documents to packed training sequences, in stages that are written and read again.

Every stage but the last returns the columns of `documents`; n_chars follows the text. A stage of an empty table
returns an empty one. Rows with a null doc_id, a null or empty text or equal rows go through every stage by its rule
below; further columns, whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import mixing, packing, pii, quality
from weft.llm.near_dedup import near_duplicates
from weft.llm.scratch import Scratch


#: Bytes of an Arrow batch: what a task holds at once beside its heap, in the JVM and again in its Python worker.
BATCH_BYTES = 8 << 20


def _lean(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's 64 MB, unless the session has set them."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("64MB", str(64 << 20), f"{64 << 20}b"):
        spark.conf.set(name, str(BATCH_BYTES))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.3; learnt from `labels` outside the held-out fifth.

    A null text scores as an empty one; a score of 0.3 stays; without labels to learn from, all stay.
    """
    _lean(spark)
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (five-word shingles, similarity 0.8): that of smallest doc_id.

    Rows that repeat a doc_id stay or go together; rows with a null doc_id stay, and so do texts without words.
    """
    _lean(spark)
    found = near_duplicates(docs)
    gone = found.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data replaced by their kind; null and empty texts stay as they are."""
    _lean(spark)
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document; where a source's budget cuts one, its first words only.

    A cut text's words are joined by single spaces. Documents of which nothing is taken go. Rows are numbered first,
    so those that repeat a doc_id, or have none, get just what the mix takes of each. A text without words gives
    nothing to the mix and goes.
    """
    _lean(spark)
    own = "_mix_row"
    while own in docs.columns:
        own += "_"
    rows = Scratch(spark, "mixrows").keep(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    taken = mixing.mixed(rows, extra=(own,)).where("taken > 0")
    each = F.expr("concat(array_repeat(size, cast(taken div size as int)), if(taken % size > 0, array(taken % size), array()))")
    taken = taken.select(F.col(own).alias("_mix_id"), F.col("size").alias("_mix_size"), F.explode(each).alias("_mix_words"))
    rows = rows.join(taken, F.col(own) == F.col("_mix_id"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0)), F.lit(1), F.col("_mix_words").cast("int")), " ")
    text = F.when(F.col("_mix_words") < F.col("_mix_size"), cut).otherwise(F.col("text"))
    rows = rows.select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*(f"`{c}`" for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left and their places in sequences of 4096 tokens; equal pieces are interchangeable."""
    _lean(spark)
    return packing.packed(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Classifier, signatures and packing aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    tmp = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = tmp.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
