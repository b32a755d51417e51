"""Mixing sources to target weights by distributed prefix sums over a hash-random order.

Every document gets a hash-random key. Within a source the keys are range-partitioned by their leading digits, the
sizes of each range are summed, the running sum over ranges gives each range its offset, and inside a range a
running sum in key order does the rest: a source that holds a third of all rows is spread over all its ranges. The
source's budget is cut exactly where the prefix sum reaches it, after as many whole epochs as fit.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Rows of a range, about, and the fewest leading hexadecimal digits of a key that name one.
RANGE, DIGITS = 5_000, 3


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: tuple[int, int] = (3, 2),
    most: int = 2,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and the columns of `extra`, a row for each row of `docs`.

    Size: words of the text (a null has none). Sources are ordered by code point, null last, and weighted in turn;
    together they get share[0]/share[1] of all words, none more than `most` times its own, with what that leaves
    given to the others by weight. taken is the words that the mix takes of the row, repeats counted: a whole number
    of epochs, then the rows of least key, the last of them in part, until the floor of the target is reached.
    The key is a hash of the id and of the text, so rows that repeat an id or have none are spread like all others;
    only rows equal in both share a key, and they are interchangeable. The list of the sources, a row each, is
    ordered in one task. A null source is a source; an empty table gives no rows.
    """
    tmp = Scratch(docs.sparkSession, "mix")
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    key = F.md5(F.concat_ws("/", F.coalesce(F.col(id_col).cast("string"), F.lit("")), text).cast("binary"))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        key.alias("_key"),
        *extra,
    )
    rows = tmp.keep(rows, "sizes")
    digits = max(DIGITS, math.ceil(math.log(max(1, rows.count() / RANGE), 16)))
    rows = rows.withColumn("_range", F.substring("_key", 1, digits))
    ranges = tmp.keep(rows.groupBy("source", "_range").agg(F.sum("size").alias("part")), "ranges")
    sources = ranges.groupBy("source").agg(F.sum("part").alias("source_size"))
    # One row for each source from here to the targets; windows without a partition hold no more than that.
    turn = (F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1) % len(weights)
    s = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    everything = Window.partitionBy()
    s = s.withColumn("budget", F.sum("source_size").over(everything) * share[0] / F.lit(share[1])).withColumn("all_w", F.sum("w").over(everything))
    before = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("capped", F.col("ratio") * (F.col("all_w") - F.col("w_before")) <= F.col("budget") - F.col("cap_before"))
    s = s.withColumn("cap_all", F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything)).withColumn("w_free", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(everything))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("budget") - F.col("cap_all")) * F.col("w") / F.col("w_free"))
    s = tmp.keep(s.select("source", "source_size", target.alias("target")), "sources")

    offset = F.sum("part").over(Window.partitionBy("source").orderBy("_range")) - F.col("part")
    ranges = ranges.select(F.col("source").alias("s"), F.col("_range").alias("r"), offset.alias("_offset"))
    within = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("_upto", F.sum("size").over(within))
    out = out.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("_range") == F.col("r"))).drop("s", "r")
    out = out.join(s.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    left = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - (F.col("_offset") + F.col("_upto") - F.col("size"))))
    return out.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), *extra)


#: The same in DuckDB, over `documents`, with the parameters' defaults.
SQL = r"""
with rows as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(coalesce(doc_id::varchar, '') || '/' || md5(coalesce(text, ''))) as k
  from documents),
sources as (select source, sum(size)::bigint as source_size from rows group by source),
turned as (
  select *, [5, 2, 1][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int] as w from sources),
ratios as (
  select *, 2 * source_size as cap, (2 * source_size)::double / w as ratio,
         (sum(source_size) over ())::double * 3 / 2 as budget, sum(w) over () as all_w from turned),
sums as (
  select *, coalesce(sum(cap) over b, 0) as cap_before, coalesce(sum(w) over b, 0) as w_before from ratios
  window b as (order by ratio, source is null, source rows between unbounded preceding and 1 preceding)),
flags as (select *, ratio * (all_w - w_before) <= budget - cap_before as capped from sums),
rest as (
  select *, sum(case when capped then cap else 0 end) over () as cap_all,
         sum(case when capped then 0 else w end) over () as w_free from flags),
targets as (
  select source, source_size,
         case when capped then cap::double else (budget - cap_all::double) * w / w_free end as target from rest),
placed as (
  select r.doc_id, r.source, r.size, t.source_size, t.target,
         sum(r.size) over (partition by r.source order by r.k, r.doc_id, r.size rows between unbounded preceding and current row) - r.size as before,
         floor(t.target)::bigint as goal
  from rows r join targets t on r.source is not distinct from t.source)
select doc_id, size, source_size, target,
       ((case when source_size > 0 then goal // source_size else 0 end) * size
        + greatest(0, least(size, goal - (case when source_size > 0 then goal // source_size else 0 end) * source_size - before)))::bigint as taken
from placed
"""
