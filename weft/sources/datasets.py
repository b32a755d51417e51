"""Rows of published tasks as (context, continuation, answers), and tokenizer tables that are checked as they are read."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _rows(df: DataFrame, context: Column, answers: Column) -> DataFrame:
    out = df.select("*", context.alias("_context"), answers.alias("_answers")).where(F.size("_answers") > 0)
    kept = [c for c in df.columns if c.startswith("key")]
    return out.select(*kept, F.col("_context").alias("context"), F.col("_answers")[0].alias("continuation"), F.col("_answers").alias("answers"))


def arithmetic(df: DataFrame) -> DataFrame:
    """Rows of (context, completion)."""
    return _rows(df, F.col("context"), F.array("completion"))


def prompt_answer(df: DataFrame) -> DataFrame:
    """Rows of (prompt, answer)."""
    return _rows(df, F.col("prompt"), F.array("answer"))


def _question(passage: Column, question: Column) -> Column:
    blank = lambda x: F.trim(F.coalesce(x, F.lit("")))
    return F.concat(F.lit("Passage: "), blank(passage), F.lit("\n\nQuestion: "), blank(question), F.lit("\nAnswer:"))


def reading(df: DataFrame) -> DataFrame:
    """Rows of (passage, question, spans); blank spans go, and rows without any."""
    return _rows(df, _question(F.col("passage"), F.col("question")), F.filter(F.coalesce("spans", F.array().cast("array<string>")), lambda s: F.trim(s) != ""))


def multi_hop(df: DataFrame) -> DataFrame:
    """Rows of (titles, sentences, question, answer): a line for each title, with its sentences; rows without an answer go."""
    lines = F.zip_with("titles", "sentences", lambda t, s: F.concat(t, F.lit(": "), F.array_join(s, " ")))
    lines = F.slice(lines, F.lit(1), F.least(F.size("titles"), F.size("sentences")))
    answer = F.trim(F.coalesce("answer", F.lit("")))
    return _rows(df, _question(F.array_join(lines, "\n"), F.col("question")), F.filter(F.array(answer), lambda a: a != ""))


def programs(df: DataFrame, *columns: str) -> DataFrame:
    """(prompt and the given columns) of programming tasks; nulls as empty texts. The programs are never run here."""
    return df.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("prompt", *columns)))


def task_list(spark: SparkSession, path: str) -> DataFrame:
    """A list of tasks from a JSON file of objects, one row each."""
    return spark.read.json(path, multiLine=True)


def write_vocabulary(vocabulary: DataFrame, path: str, **about) -> None:
    """(token, rank) as Parquet and what is known about them as a line of JSON; never pickled."""
    spark = vocabulary.sparkSession
    ids = vocabulary.agg(F.count("*").alias("n"), F.max("rank").alias("most")).first()
    vocabulary.write.mode("errorifexists").parquet(f"{path}/ranks")
    spark.createDataFrame([(json.dumps({"size": ids["n"], "most": ids["most"], **about}, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/about")


def read_vocabulary(spark: SparkSession, path: str, allow_buffer: bool = False) -> DataFrame:
    """(token, rank) of a written vocabulary; one that isn't finalized, of another size than it says or with ranks out of range is an error."""
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    if about.get("buffer") and not allow_buffer:
        raise ValueError("the vocabulary is not finalized")
    rows = spark.read.parquet(f"{path}/ranks")
    found = rows.agg(F.count("*").alias("n"), F.min("rank").alias("least"), F.max("rank").alias("most"), F.count_distinct("rank").alias("kinds")).first()
    if found["n"] != about["size"] or found["kinds"] != found["n"] or found["least"] < 0 or found["most"] >= about.get("limit", about["most"] + 1):
        raise ValueError("the vocabulary is not what its description says")
    return rows


def checked_sizes(sizes: DataFrame, vocabulary: int) -> DataFrame:
    """(id, n_bytes) of every id of a vocabulary; another number of rows is an error."""
    n = sizes.count()
    if n != vocabulary:
        raise ValueError(f"{n} byte lengths for {vocabulary} ids")
    return sizes


def special_ids(vocabulary: DataFrame, specials: list[str]) -> dict[str, int]:
    """Ids of the special tokens, in order after the mergeable ones."""
    n = vocabulary.agg(F.max("rank")).first()[0]
    return {x: (-1 if n is None else n) + 1 + i for i, x in enumerate(specials)}
