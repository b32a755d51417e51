"""Training rows of fixed length by best fit from a bounded look-ahead, one sequence of rows per rank."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill(lengths: Iterator[tuple[int, int]], capacity: int, look_ahead: int) -> Iterator[list[tuple[int, int]]]:
    """Rows of (document, tokens taken) that hold exactly `capacity` tokens each.

    From the waiting documents the longest that fits, the earliest on a tie; if none fits, the shortest is cropped
    to what is left and its remainder dropped. What can't fill a row at the end is not given out.
    """
    waiting: list[tuple[int, int, int]] = []  # (length, -arrival, document), sorted
    arrived, row, left, more = 0, [], capacity, True
    while True:
        while more and len(waiting) < look_ahead:
            nxt = next(lengths, None)
            if nxt is None:
                more = False
            else:
                bisect.insort(waiting, (nxt[1], -arrived, nxt[0]))
                arrived += 1
        if not waiting:
            return
        at = bisect.bisect_right(waiting, (left, 1, 0))
        if at:
            # Of equal lengths the earliest stands last.
            n, _, doc = waiting.pop(at - 1)
        else:
            last_of_shortest = bisect.bisect_right(waiting, (waiting[0][0], 1, 0))
            n, _, doc = waiting.pop(last_of_shortest - 1)
            n = left
        row.append((doc, n))
        left -= n
        if not left:
            yield row
            row, left = [], capacity


def _batch(out: list[tuple[int, int, int, int, int, int]]) -> pa.RecordBatch:
    part = list(zip(*out))
    names = ["rank", "row_no", "place", "doc", "nth", "taken"]
    return pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), *(pa.array(x, pa.int64()) for x in part[1:])], names=names)


def with_first_id(ids: Column, rows: Column | None, bos: int, default: list[int] | None) -> tuple[Column, Column | None]:
    """(ids, rows) behind the first id and its default row; rows of another number than the ids are an error."""
    whole = F.concat(F.array(F.lit(bos)), F.coalesce(ids, F.array().cast("array<int>")))
    if rows is None:
        return whole, None
    first = F.array(F.array(*map(F.lit, default)))
    given = F.concat(first, F.coalesce(rows, F.array().cast("array<array<int>>")))
    return whole, F.when(F.size(given) == F.size(whole), given).otherwise(F.raise_error(F.lit("ids and modifier rows differ in number")).cast("array<array<int>>"))


def training_rows(docs: DataFrame, key: str, ids: str, capacity: int, ranks: int, bos: int, look_ahead: int = 1000, rows: str | None = None, default: list[int] | None = None) -> DataFrame:
    """(rank, row_no, inputs, targets), with `rows` (input_rows, target_rows) too: rows of `capacity` + 1 tokens, shifted by one.

    Each document stands behind the first id, and documents stand in a row in the order in which the packing took them.
    `rows` are modifier rows of each document, as many as ids, else it is an error; the first id has the default row. The
    packing sees lengths only; tokens and rows join the places that it gives. Rows that repeat a key are documents each;
    a null document is the first id alone.
    """
    whole, own = with_first_id(F.col(ids), F.col(rows) if rows else None, bos, default)
    whole = docs.select(F.col(key).cast("long").alias("doc"), whole.alias("t"), *([own.alias("m")] if rows else []))
    # Documents of one key are told apart by what they hold; equal ones are interchangeable.
    whole = whole.withColumn("nth", F.row_number().over(Window.partitionBy("doc").orderBy(F.size("t"), F.xxhash64("t"), "t")).cast("long"))
    placed = packed_rows(whole.select("doc", "nth", F.size("t").alias("n")), "doc", "n", capacity + 1, ranks, look_ahead, "nth")
    cut = [F.slice(x, F.lit(1), F.col("taken").cast("int")).alias(x) for x in (("t", "m") if rows else ("t",))]
    parts = placed.join(whole, placed["doc"].eqNullSafe(whole["doc"]) & (placed["nth"] == whole["nth"])).select("rank", "row_no", "place", *cut)
    held = F.array_sort(F.collect_list(F.struct("place", *(["t", "m"] if rows else ["t"]))))
    made = parts.groupBy("rank", "row_no").agg(held.alias("held"))
    halves = lambda x, a, b: [F.slice(F.flatten(F.col(f"held.{x}")), start, capacity).alias(n) for start, n in ((1, a), (2, b))]
    return made.select("rank", "row_no", *halves("t", "inputs", "targets"), *(halves("m", "input_rows", "target_rows") if rows else []))


def packed_rows(docs: DataFrame, key: str, length: str, capacity: int, ranks: int, look_ahead: int = 1000, nth: str | None = None) -> DataFrame:
    """(rank, row_no, place, doc, nth, taken): place is the order in which the row took its documents; documents are dealt to the ranks by a hash, each rank's in the order of the key.

    A rank is a reader of its own, as many as the training job has; its documents stream through a buffer of
    `look_ahead` lengths.
    """
    def run(batches):
        source = ((r, d, n) for b in batches for r, d, n in zip(b.column(0).to_pylist(), zip(b.column(1).to_pylist(), b.column(2).to_pylist()), b.column(3).to_pylist()))
        head = next(source, None)
        while head is not None:
            rank, held = head[0], [head]

            def own():
                while held:
                    yield held.pop()[1:]
                    x = next(source, None)
                    if x is not None and x[0] == rank:
                        held.append(x)
                    else:
                        nxt.append(x)

            nxt: list = []
            out: list[tuple[int, int, int, int, int, int]] = []
            for i, row in enumerate(fill(own(), capacity, look_ahead)):
                out += ((rank, i, place, *d, n) for place, (d, n) in enumerate(row))
                if len(out) >= 10_000:  # as rows fill, not when the rank ends
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)
            head = nxt[0] if nxt else None

    dealt = docs.where(F.col(length) > 0).select(F.pmod(F.xxhash64(key), F.lit(ranks)).cast("int").alias("rank"), F.col(key).cast("long").alias("doc"), (F.col(nth) if nth else F.lit(1)).cast("long").alias("nth"), F.col(length).cast("long").alias("n"))
    return dealt.repartition(ranks, "rank").sortWithinPartitions("rank", "doc", "nth", "n").mapInArrow(run, "rank int, row_no long, place long, doc long, nth long, taken long")
