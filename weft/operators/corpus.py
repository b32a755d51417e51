"""Corpus preparation: counts, budgets, order-dependent selection and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.sources.shared import Tables


def counts(df: DataFrame, text: str) -> DataFrame:
    """Documents and code points."""
    return df.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n_chars"))


def running_total(df: DataFrame, order: str, amount: Column, width: int, out: str) -> DataFrame:
    """Sum of `amount` over the rows that come before in the order of an integer column.

    Two levels, so that no task sorts everything: rows fall into ranges of `width` values, the ranges' totals are
    summed along the few ranges, and a window inside each range does the rest.
    """
    rows = df.withColumn("_range", F.floor(F.col(order) / width)).withColumn("_amount", F.coalesce(amount, F.lit(0)))
    ranges = rows.groupBy("_range").agg(F.sum("_amount").alias("_sum"))
    ranges = ranges.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_base"))
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(out, F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    return rows.join(ranges, "_range").withColumn(out, F.col(out) + F.col("_base")).drop("_range", "_base", "_amount")


def within_budget(df: DataFrame, order: str, text: str, most_chars: int, cap: int, change=None, width: int = 1 << 14) -> DataFrame:
    """Documents, cropped and changed, up to and with the one that takes the cropped characters over the budget.

    What is empty after the change counts in the budget but isn't kept.
    """
    cropped = df.withColumn(text, F.substring(text, 1, cap) if cap > 0 else F.col(text))
    kept = running_total(cropped, order, F.length(text), width, "_before").where(F.col("_before") <= most_chars).drop("_before")
    if change is not None:
        kept = kept.withColumn(text, change(F.col(text)))
    return kept.where(F.length(text) > 0)


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: later passes overwrite earlier ones."""
    return first_wins(df, keys, [F.desc(c) for c in order])


def renumbered(df: DataFrame, order: str | list[str], out: str) -> DataFrame:
    """Dense ranks from 0 in an order: rows are sorted into ranges once and written, and each range starts after those before it.

    Rows that tie are ranked in whatever order they were written.
    """
    order = [order] if isinstance(order, str) else order
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows = Tables(df.sparkSession, "ranks").keep(ranges.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part, nth = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    sizes = sorted_rows.groupBy(part.alias("_part")).agg((F.max(nth) + 1).alias("_n"))
    # A row for each range, not for each of its rows.
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return sorted_rows.withColumn("_part", part).join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + nth).alias(out))


def requested(tasks: DataFrame, wanted: DataFrame, name: str, excluded: DataFrame | None = None) -> DataFrame:
    """Tasks in the order in which they are asked for, whatever the case, each once, but for excluded ones; a name that is unknown, asked for or excluded, is an error."""

    def known(names: DataFrame, *keep) -> DataFrame:
        asked = names.groupBy(F.lower(F.trim(name)).alias("_k")).agg(*keep)
        found = asked.join(tasks.withColumn("_k", F.lower(name)), "_k", "left")
        return found.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.concat(F.lit("unknown task: "), F.col("_k")))).otherwise(F.col(name)))

    found = known(wanted, F.min("pos").alias("pos")).drop("_k")
    return found if excluded is None else found.join(known(excluded, F.count("*").alias("_n")).select(name), name, "left_anti")


def sample_by_hash(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A fixed sample of n rows: those of least hash."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def digests(files: DataFrame, name: str, content: str) -> DataFrame:
    """SHA-256 of each file's bytes."""
    return files.select(name, F.sha2(F.col(content), 256).alias("digest"))


def fingerprint(files: DataFrame, name: str, content: str) -> DataFrame:
    """One digest of all files: of name, zero byte, digest, zero byte, in the order of names."""
    parts = digests(files, name, content).agg(F.array_sort(F.collect_list(F.struct(name, "digest"))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: F.concat(x[name], F.lit("\0"), x["digest"], F.lit("\0"))), "")
    return parts.select(F.sha2(joined.cast("binary"), 256).alias("fingerprint"))
