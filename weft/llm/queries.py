"""Queries of this package: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import collocations, fill_middle, language, mixing, packing, pii, quality, token_counts
from weft.llm.ivfpq import near_duplicate_vectors, search
from weft.llm.near_dedup import near_duplicates
from weft.llm.sharding import shuffled
from weft.llm.substring_dedup import without_repeats


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` without the words of 13-word runs that a smaller doc_id has."""
    return without_repeats(_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text of `documents`, learnt from `labels` outside the held-out fifth."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    out = quality.scored(docs, model)
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every 20th vector of `embeddings`, the 20 others of largest inner product."""
    rows = _table(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of `documents` over 4-word shingles of the lower-cased text, similarity 0.8."""
    found = near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80, lower=True)
    return found.select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` packed into sequences of 4096 tokens."""
    return packing.packed(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every text of `documents`, each text encoded whole."""
    return token_counts.counted(_table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of `embeddings` of one label with a cosine of 0.98 or more, and their components."""
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text of `documents`."""
    return pii.find(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text of `documents`, learnt outside the held-out fifth."""
    docs = _table(spark, sf_dir, "documents")
    out = language.identified(docs, language.train(docs))
    return out.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words a mix of the sources of `documents` takes of each document."""
    return mixing.mixed(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` in a random order of seed 42, cut into 40 shards of equally many rows."""
    out = shuffled(_table(spark, sf_dir, "documents"), shards=40, seed=42)
    crc = F.crc32(F.coalesce("record.text", F.lit("")).cast("binary")).alias("text_crc32")
    return out.select("record.doc_id", "size", crc, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of two to four words in each language of `documents`."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` transformed for filling in the middle, and restored, as digests."""
    out = fill_middle.filled(_table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


_ALL = (op1_substring_dedup, op2_quality_classifier, op3_ann_search, op4_minhash_near_dedup, op5_best_fit_packing, op6_token_counts, op7_embedding_near_dedup, op8_pii, op9_language_id, op10_mixing, op11_two_pass_shuffle, op12_collocations, op13_fill_in_middle)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

#: DuckDB SQL for those queries that SQL can express over whole tables.
ORACLE_SQL: dict[str, str] = {"op10_mixing": mixing.SQL, "op12_collocations": collocations.SQL, "op13_fill_in_middle": fill_middle.SQL}
