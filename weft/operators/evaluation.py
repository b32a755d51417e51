"""Scores of model output that is given as columns, gathers over token ids, and the choice of a checkpoint."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_match(predicted: Column, actual: Column) -> Column:
    """Whether all ids are as they should be."""
    return predicted == actual


def modifiers_match(predicted: Column, actual: Column, suffix_group: int, default: int) -> Column:
    """Whether all modifier rows are; where the last one should have no suffix, the suffix that is predicted there doesn't count."""
    last = F.size(actual)
    forgiving = F.element_at(F.element_at(actual, last), suffix_group + 1) == default
    freed = lambda rows: F.transform(rows, lambda r, i: F.when(forgiving & (i == last - 1), F.transform(r, lambda v, g: F.when(g == suffix_group, default).otherwise(v))).otherwise(r))
    return F.when(last == 0, F.size(predicted) == 0).otherwise(freed(predicted) == freed(actual))


def surface_loss(base: Column, groups: Column) -> Column:
    """Loss of a surface token: that of its base and of each of its modifier groups, added."""
    return base + F.aggregate(groups, F.lit(0.0), lambda s, x: s + x)


def weighted_loss(df: DataFrame, keys: list[str], base: Column, groups: Column, mask: Column, base_weight: float = 1.0, modifier_weight: float = 1.0) -> DataFrame:
    """Masked means of the base's loss and of the groups' added losses, and their weighted sum."""
    m, every = mask.cast("double"), F.aggregate(groups, F.lit(0.0), lambda s, x: s + x)
    mean = lambda x: F.sum(x * m) / F.greatest(F.sum(m), F.lit(1.0))
    out = df.groupBy(*keys).agg(mean(base).alias("base_loss"), mean(every).alias("modifier_loss"))
    return out.withColumn("loss", base_weight * F.col("base_loss") + modifier_weight * F.col("modifier_loss"))


def generated(df: DataFrame, prompt: str, generate, out: str = "predicted") -> DataFrame:
    """`df` with what a callable makes of its prompts: a function of a list of texts, called on Arrow batches in the executors."""
    import pyarrow as pa

    at = df.columns.index(prompt)
    schema = df.withColumn(out, F.lit("")).schema

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(generate(b.column(at).to_pylist()), pa.string())], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)


def settings_key(settings: dict) -> str:
    """A digest of settings, whatever the order in which they are given."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def task_accuracy(df: DataFrame, task: str, correct: str) -> DataFrame:
    return df.groupBy(task).agg(F.avg(F.col(correct).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def mean_of_splits(df: DataFrame, split: str, correct: str) -> DataFrame:
    """The mean of the splits' accuracies, each split alike."""
    return task_accuracy(df, split, correct).agg(F.avg("accuracy").alias("accuracy"), F.count("*").alias("n_splits"))


def gathered(df: DataFrame, id_col: str, table: DataFrame, key: str, value: str, default=None) -> DataFrame:
    """`df` with the value that a table has for its id; a default where it has none."""
    own = table.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    out = df.join(own, F.col(id_col) == F.col("_key"), "left").drop("_key")
    return out.withColumn(value, F.coalesce("_value", F.lit(default)) if default is not None else F.col("_value")).drop("_value")


def first_hit(df: DataFrame, key: str, candidates: Column, table: DataFrame, name: str) -> DataFrame:
    """(key, rank, hit): of each row's candidates in order the first that the table names; null if it names none."""
    each = df.select(key, F.posexplode(candidates).alias("rank", "candidate"))
    found = each.join(table.select(F.col(name).alias("candidate")).distinct(), "candidate").groupBy(key).agg(F.min(F.struct("rank", "candidate")).alias("m"))
    return df.select(key).join(found, key, "left").select(key, F.col("m.rank").alias("rank"), F.col("m.candidate").alias("hit"))


def with_owner(variants: DataFrame, owners: DataFrame, key: str, owner: str) -> DataFrame:
    """Each variant's owner; a variant without one owns itself."""
    return variants.join(owners.select(key, owner), key, "left").withColumn(owner, F.coalesce(owner, key))


def last_values(df: DataFrame, key: list[str], group: str, pos: str, value: str, default: int = 0) -> DataFrame:
    """Of each group the last value that isn't the default, and the default where all are."""
    last = F.max_by(F.when(F.col(value) != default, F.col(value)), F.when(F.col(value) != default, F.col(pos)))
    return df.groupBy(*key, group).agg(F.coalesce(last, F.lit(default)).alias(value))


def latest_complete(files: DataFrame, keys: list[str], step: str, kind: str, rank: str, world: int, markers: DataFrame | None = None) -> DataFrame:
    """Of each folder the newest step that has its model, its description and an optimizer file of every rank, and whether a marker names it."""
    steps = files.groupBy(*keys, step).agg(
        F.bool_or(F.col(kind) == "model").alias("model"), F.bool_or(F.col(kind) == "meta").alias("meta"), F.count_distinct(F.when((F.col(kind) == "optim") & (F.col(rank) < world), F.col(rank))).alias("ranks")
    )
    whole = steps.where(F.col("model") & F.col("meta") & (F.col("ranks") == world))
    newest = whole.groupBy(*keys).agg(F.max(step).alias(step))
    if markers is None:
        return newest.withColumn("marked", F.lit(False))
    return newest.join(markers.select(*keys, step).distinct().withColumn("_m", F.lit(True)), [*keys, step], "left").withColumn("marked", F.coalesce("_m", F.lit(False))).drop("_m")


def span_of_change(without: Column, full: Column) -> tuple[Column, Column]:
    """(start, end) of what `full` has that `without` hasn't: between their common prefix and, no longer than the rest, their common suffix."""
    least = F.least(F.size(without), F.size(full))

    def same(a: Column, b: Column, n: Column) -> Column:
        differs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x != y)
        at = F.array_position(differs, True)
        return F.when(at == 0, n).otherwise((at - 1).cast("int"))

    start = same(without, full, least)
    return start, F.size(full) - same(F.reverse(without), F.reverse(full), least - start)
