"""Token sequences as arrays: padding, tails, stops, shifts, spans, prompts and seeded samples."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def padded(ids: Column, n: int, pad: int = 0) -> Column:
    """Exactly n elements: the first n, or filled up on the right."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), n)), 1, n)


def stacked(df: DataFrame, ids: str, pad: int = 0, rows: str | None = None, default: list[int] | None = None) -> DataFrame:
    """Every sequence filled up on the right to the longest one; none loses an element.

    `rows` are modifier rows beside the ids, filled up with the default row: to stack them without one, or to give rows
    for some sequences only or in another number than the ids, is an error.
    """
    if rows is not None and default is None:
        raise ValueError("stacking modifier rows needs the default row")
    longest = df.agg(F.max(F.size(ids))).first()[0] or 0
    left = F.lit(longest) - F.size(ids)
    if rows is not None:
        same = F.coalesce(F.size(rows) == F.size(ids), F.lit(False))
        fill = F.array_repeat(F.array(*map(F.lit, default)).cast(df.schema[rows].dataType.elementType), left)
        checked = F.when(same, F.concat(rows, fill)).otherwise(F.raise_error(F.lit("every sequence needs as many modifier rows as ids")).cast(df.schema[rows].dataType))
        df = df.withColumn(rows, checked)
    return df.withColumn(ids, F.concat(ids, F.array_repeat(F.lit(pad), left)))


def tail(ids: Column, n: int) -> Column:
    """The last n elements, all if there are fewer."""
    return F.slice(ids, F.greatest(F.size(ids) - n + 1, F.lit(1)), F.lit(n))


def before_stop(ids: Column, stops: list[int]) -> Column:
    """The elements before the first stop."""
    at = F.array_position(F.transform(ids, lambda i: i.isin(stops)), True)
    return F.when(at == 0, ids).otherwise(F.slice(ids, F.lit(1), (at - 1).cast("int")))


def shifted(ids: Column) -> tuple[Column, Column]:
    """(inputs, targets): each target is the element after its input."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.slice(ids, F.lit(1), n), F.slice(ids, F.lit(2), n)


def with_bos(ids: Column, rows: Column | None, bos: int, default: list[int]) -> tuple[Column, Column | None]:
    """The sequence behind a first id, which has the default modifiers."""
    head = F.array(F.lit(bos))
    return F.concat(head, ids), None if rows is None else F.concat(F.array(F.array(*map(F.lit, default))), rows)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two sequences."""
    n = F.least(F.size(a), F.size(b))
    differs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x != y)
    at = F.array_position(differs, True)
    return F.when(at == 0, n).otherwise((at - 1).cast("int"))


def continuation_span(without: Column, full: Column) -> tuple[Column, Column]:
    """(start, end) of what `full` has beyond `without`; empty spans are an error."""
    start = common_prefix(without, full)
    end = F.size(full)
    return start, F.when(end > start, end).otherwise(F.raise_error(F.lit("empty continuation span")))


def spread(row: Column, n: Column, first_groups: list[int], position: str = "split_by_role") -> Column:
    """One modifier row over n base tokens: all on the first or the last, or some groups on the first and the rest on the last."""
    empty = F.transform(row, lambda v: v * 0)
    firsts = F.transform(row, lambda v, g: F.when(g.isin(first_groups), v).otherwise(0))
    lasts = F.transform(row, lambda v, g: F.when(g.isin(first_groups), 0).otherwise(v))
    head, end = {"split_by_role": (firsts, lasts), "first": (row, empty), "last": (empty, row)}[position]
    return F.when(n <= 1, F.array(row)).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i == 1, head).when(i == n, end).otherwise(empty)))


def rendered(shots: Column, context: Column, delimiter: str = " ") -> Column:
    """A few-shot prompt: each shot's context and answer, then the context, blank lines between."""
    shown = F.transform(shots, lambda s: F.concat(s["context"], F.lit(delimiter), s["answer"]))
    return F.array_join(F.concat(shown, F.array(context)), "\n\n")


def choice_prompt(shots: Column, context: Column, answer: Column, delimiter: str = " ") -> Column:
    """The shots, then a context and one of its answers: a prompt for each choice, or for each context of one continuation."""
    return rendered(shots, F.concat(context, F.lit(delimiter), answer), delimiter)


def continuation_prompts(shots: Column, context: Column, continuation: Column, delimiter: str = " ") -> tuple[Column, Column]:
    """(without, with) the continuation; contexts are trimmed, and so is the whole prompt that ends without."""
    blank = " \t\n\r"
    shots = F.transform(shots, lambda s: F.struct(F.btrim(s["context"], F.lit(blank)).alias("context"), s["answer"].alias("answer")))
    head = rendered(shots, F.concat(F.btrim(context, F.lit(blank)), F.lit(delimiter)), delimiter)
    return F.btrim(head, F.lit(blank)), F.concat(head, continuation)


def seeded_shuffle(ids: list, seed: int, most: int = 0) -> list:
    """A shuffle as Python's generator makes it, cut to `most` where that is above 0."""
    out = list(ids)
    random.Random(seed).shuffle(out)
    return out[:most] if most > 0 else out


def few_shots(rows: DataFrame, task: str, index: str, k: int, seed: int = 1234) -> DataFrame:
    """(task, index, shots): the indices of k other rows of a task, as Python's generator seeded by seed + index draws them.

    Tasks are numbered without gaps, so the others of a row are known from the count alone, and no rows meet.
    """
    sized = rows.groupBy(task).agg(F.count("*").alias("_n"))
    schema = rows.select(task, index).withColumn("shots", F.array(F.lit(0).cast("long"))).schema

    def run(batches):
        for b in batches:
            shots = []
            for i, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                drawn = random.Random(seed + i).sample(range(n - 1), min(k, n - 1)) if n > 1 else []
                shots.append([x + (x >= i) for x in drawn])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shots, pa.list_(pa.int64()))], names=[task, index, "shots"])

    return rows.join(sized, task).select(task, index, "_n").mapInArrow(run, schema)
