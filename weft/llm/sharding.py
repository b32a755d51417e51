"""Global shuffle into shards by a two-pass external shuffle, with DataFrame functions only.

The first pass scatters records by a seeded hash of all their columns into buckets that fit in memory many times over.
The second draws a Fisher-Yates permutation of each bucket's places (`shuffle` of a sequence) and puts the bucket's
records, numbered in hash order, where it says. Buckets in order, each permuted, are one random order of all records;
shards are equal cuts of it, so their counts of rows differ by one at most.

Both passes are functions of the records and the seed: a task that is run again, or a cluster of another size, gives
the same order. Records that are equal in every column are told apart by a copy number, so even a third of all rows
can be copies of one without filling a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.scratch import Scratch

#: Bytes and rows of a bucket, about.
BUCKET_BYTES, BUCKET_ROWS = 4 << 20, 2048
#: Bytes of a shuffle partition, which holds many buckets, if the session's number of partitions would give more.
PARTITION_BYTES = 256 << 20
#: Equal records beyond this number are numbered.
COPIES = BUCKET_ROWS // 4
#: Buckets whose counts are summed before one task orders the sums, and copies that one task writes out.
TOGETHER = 4096


def size_of(text: Column) -> Column:
    """Bytes of the text in UTF-8, and 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def _comparable(docs: DataFrame) -> list[Column]:
    """The columns as values that can be hashed and grouped."""
    known = lambda kind: not any(x in kind for x in ("map<", "variant", "interval", "geo"))
    return [F.col(f"`{c}`") if known(kind) else F.to_json(F.struct(F.col(f"`{c}`"))) for c, kind in docs.dtypes]


def shuffled(docs: DataFrame, shards: int = 40, seed: int = 42, text_col: str = "text") -> DataFrame:
    """record (a struct of all columns of `docs`), size, shard and slot, a row for each row of `docs`.

    `slot` is a record's place in its shard, from 0 without gaps; shards are numbered from 0 and hold equally many
    records, or one more. Nulls, empty texts and repeated ids are values like any other. Rows equal in every column
    are interchangeable and are spread over all shards. Columns may have any names, as they stay within `record`. An
    empty table gives no rows; with fewer rows than shards some shards are empty.
    """
    spark, tmp = docs.sparkSession, Scratch(docs.sparkSession, "shards")
    same = F.struct(*_comparable(docs))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("record"), same.alias("same"), size_of(F.col(text_col)).alias("size"))
    rows = rows.withColumn("hash", F.xxhash64("same", F.lit(seed)))
    counts = tmp.keep(rows.groupBy("hash").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "counts")
    total, weight = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    buckets = max(1, -(-weight // BUCKET_BYTES), -(-total // BUCKET_ROWS))
    parts = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets), -(-weight // PARTITION_BYTES))

    scattered = rows.select("record", "size", "hash", F.lit(0).cast("long").alias("copy"))
    copied = tmp.keep(counts.where(F.col("n") > COPIES).select("hash"), "copied")
    if copied.head(1):
        once = rows.join(copied, "hash", "left_semi").groupBy("hash", "same").agg(F.count("*").alias("n"), F.first("record").alias("record"), F.first("size").alias("size"))
        some = once.withColumn("part", F.explode(F.expr(f"sequence(0L, (n - 1) div {TOGETHER})"))).repartition(parts, "hash", "part")
        each = F.expr(f"sequence(part * {TOGETHER}, least(n, (part + 1) * {TOGETHER}) - 1)")
        scattered = scattered.join(copied, "hash", "left_anti").select("record", "size", "hash", "copy").union(some.select("record", "size", "hash", F.explode(each).alias("copy")))
    scattered = scattered.withColumn("bucket", F.pmod(F.xxhash64("hash", "copy", F.lit(seed)), F.lit(buckets)))

    sizes = tmp.keep(scattered.groupBy("bucket").agg(F.count("*").alias("n")), "sizes")
    group = F.floor(F.col("bucket") / TOGETHER)
    # A row for each TOGETHER buckets, that is for each 16 GB: the one list that a single task orders.
    groups = sizes.groupBy(group.alias("g")).agg(F.sum("n").alias("all")).select("g", (F.sum("all").over(Window.orderBy("g")) - F.col("all")).alias("start"))
    within = F.sum("n").over(Window.partitionBy("g").orderBy("bucket")) - F.col("n")
    offsets = tmp.keep(sizes.withColumn("g", group).withColumn("within", within).join(groups, "g").select("bucket", "n", (F.col("start") + F.col("within")).alias("offset")), "offsets")
    # In bucket order in each partition: the generator goes on from bucket to bucket.
    drawn = offsets.repartition(parts, "bucket").sortWithinPartitions("bucket")
    drawn = drawn.select("bucket", "offset", F.shuffle(F.expr("sequence(0L, n - 1)"), F.lit(seed)).alias("places"))

    nth = F.row_number().over(Window.partitionBy("bucket").orderBy("hash", "copy", "size"))
    numbered = scattered.repartition(parts, "bucket").withColumn("nth", nth)
    out = numbered.join(drawn.hint("merge"), "bucket").withColumn("place", F.col("offset") + F.element_at("places", F.col("nth")))
    shard = F.expr(f"place * {shards} div {max(1, total)}")
    out = out.select("record", "size", "place", shard.alias("shard"))
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return out.select("record", "size", F.col("shard").cast("int").alias("shard"), (F.col("place") - first).alias("slot"))


def write_shards(docs: DataFrame, folder: str, shards: int = 40, seed: int = 42, text_col: str = "text") -> None:
    """Parquet files below `folder`/shard=N, the records of each file in the order of their slots."""
    out = shuffled(docs, shards, seed, text_col).select("record", "slot", "shard")
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
