"""Measures over tables of token losses, task results and vocabularies."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.corpus import renumbered
from weft.operators.sequences import common_prefix
from weft.sources.shared import Tables


def token_byte_stats(df: DataFrame, size: str) -> DataFrame:
    """Of the byte lengths above 0: least, most, mean and sample deviation."""
    return df.where(F.col(size) > 0).agg(F.min(size).alias("min_bytes"), F.max(size).alias("max_bytes"), F.avg(size).alias("mean_bytes"), F.stddev_samp(size).alias("std_bytes"))


def bits_per_byte(df: DataFrame, keys: list[str], loss: str, target: str, size: str) -> DataFrame:
    """Sum of nats over ln 2 times bytes, over valid targets of at least one byte; infinite without bytes."""
    ok = (F.col(target) >= 0) & (F.col(size) > 0)
    nats, total = F.sum(F.when(ok, F.col(loss)).otherwise(0.0)), F.sum(F.when(ok, F.col(size)).otherwise(0))
    return df.groupBy(*keys).agg(nats.alias("nats"), total.alias("bytes")).withColumn("bpb", F.when(F.col("bytes") > 0, F.col("nats") / (math.log(2) * F.col("bytes"))).otherwise(float("inf")))


def accuracy(df: DataFrame, keys: list[str], prediction: str, target: str, size: str) -> DataFrame:
    """Share of valid targets that are predicted, plain and by bytes; 0 without any."""
    ok = (F.col(target) >= 0) & (F.col(size) > 0)
    hit = ok & (F.col(prediction) == F.col(target))
    valid, right = F.count_if(ok), F.count_if(hit)
    b, rb = F.sum(F.when(ok, F.col(size)).otherwise(0)), F.sum(F.when(hit, F.col(size)).otherwise(0))
    return df.groupBy(*keys).agg((right / F.greatest(valid, F.lit(1))).alias("accuracy"), (rb / F.greatest(b, F.lit(1))).alias("byte_accuracy"))


def equivalence(df: DataFrame, id_col: str, surface: str, key: Column) -> DataFrame:
    """Each id's canonical id: of the surfaces with one key, the key itself, then it after a space, then the rest, by least id."""
    # The generator keeps the optimizer from working the key out once for each of its uses.
    keyed = df.select("*", F.explode(F.array(key)).alias("_key"))
    rank = F.when(F.col(surface) == F.col("_key"), 0).when(F.col(surface) == F.concat(F.lit(" "), "_key"), 1).when(F.ltrim(F.col(surface)) == F.col("_key"), 2).otherwise(3)
    best = keyed.where("_key is not null").groupBy("_key").agg(F.min(F.struct(rank.alias("r"), F.col(id_col).alias("i")))["i"].alias("canonical"))
    return keyed.join(best, "_key", "left").select(id_col, surface, F.coalesce("canonical", id_col).alias("canonical_id"))


def centered(df: DataFrame, score: str, baseline: str) -> DataFrame:
    """Scores over a random baseline in percent: (s - b/100) / (1 - b/100)."""
    b = 0.01 * F.col(baseline)
    return df.withColumn("centered", (F.col(score) - b) / (1.0 - b))


def composite(df: DataFrame, score: str, baseline: str) -> DataFrame:
    return centered(df, score, baseline).agg(F.avg("centered").alias("core"))


def by_category(df: DataFrame, category: str, score: str) -> DataFrame:
    return df.groupBy(category).agg(F.avg(score).alias("score"), F.count("*").alias("n_tasks"))


def best_choice(df: DataFrame, keys: list[str], choice: str, loss: str) -> DataFrame:
    """The choice of least loss, the first on a tie."""
    return df.groupBy(*keys).agg(F.min(F.struct(loss, choice))[choice].alias("chosen"))


def keep_set(df: DataFrame, row: str, token: str, logit: str, k: int, p: float, temperature: float) -> DataFrame:
    """Tokens that top-k and then top-p leave to sample from, with their probabilities.

    Rows are bounded: a vocabulary each. The most likely token always stays.
    """
    order = Window.partitionBy(row).orderBy(F.desc(logit), token)
    top = df.withColumn("_n", F.row_number().over(order))
    if k > 0:
        top = top.where(F.col("_n") <= k)
    w = Window.partitionBy(row)
    top = top.withColumn("_e", F.exp((F.col(logit) - F.max(logit).over(w)) / temperature)).withColumn("_p", F.col("_e") / F.sum("_e").over(w))
    top = top.withColumn("_c", F.sum("_p").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    kept = top.where((F.col("_n") == 1) | (F.col("_c") <= p))
    return kept.select(row, token, (F.col("_p") / F.sum("_p").over(w)).alias("probability"))


def drawn(kept: DataFrame, row: str, token: str, chance: Column) -> DataFrame:
    """(row, token): of the tokens that are kept, in the order of their probability, the first at which these sum to more than a number from 0 to 1, the last if none does."""
    order = Window.partitionBy(row).orderBy(F.desc("probability"), token)
    upto = kept.withColumn("_upto", F.sum("probability").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_n", F.row_number().over(order))
    first = F.min(F.when(F.col("_upto") > chance, F.struct(F.col("_n").alias("n"), F.col(token).alias("t"))))
    return upto.groupBy(row).agg(F.coalesce(first, F.max(F.struct(F.col("_n").alias("n"), F.col(token).alias("t"))))["t"].alias(token))


def debiased_average(df: DataFrame, step: str, value: str, decay: float = 0.9) -> DataFrame:
    """Exponential mean of values in the order of their steps, freed of its start at 0: a sum of weights that fall with the distance from the last."""
    ranked = renumbered(df.select(step, value), [step, value], "_rank")
    n = ranked.count()
    total = F.sum((1 - decay) * F.pow(F.lit(decay), F.lit(n - 1) - F.col("_rank")) * F.col(value))
    return ranked.agg((total / F.nullif(F.lit(1 - decay**n), F.lit(0.0))).alias("ema"))


def running_minimum(df: DataFrame, key: str, step: str, value: str) -> DataFrame:
    return df.withColumn("least", F.min(value).over(Window.partitionBy(key).orderBy(step)))


def rate_multiplier(step: Column, total: int, warmup: int, warmdown: int, final: float) -> Column:
    """Linear warm-up, 1, then linearly down to `final`."""
    progress = (total - step) / warmdown if warmdown else F.lit(1.0)
    return F.when(step < warmup, (step + 1) / max(warmup, 1)).when(F.lit(warmdown <= 0) | (step <= total - warmdown), 1.0).otherwise(progress + (1 - progress) * final)


def momentum(step: Column, total: int, warmdown: int, final: float) -> Column:
    part = step / 400
    down = (step - (total - warmdown)) / warmdown if warmdown else F.lit(0.0)
    late = F.when(F.lit(warmdown > 0) & (step >= total - warmdown), 0.97 * (1 - down) + final * down).otherwise(0.97)
    return F.when(step < 400, (1 - part) * 0.85 + part * 0.97).otherwise(late)


def collisions(df: DataFrame, keys: list[str], value: str, most: int | None = None) -> DataFrame:
    """Keys with more than one distinct value: all, or the `most` with the most values, those first."""
    out = df.groupBy(*keys).agg(F.count_distinct(value).alias("n"), F.min(value).alias("first")).where("n > 1")
    return out if most is None else out.orderBy(F.desc("n"), *keys).limit(most)


def first_surfaces(df: DataFrame, keys: list[str], surface: str, order: list[str]) -> DataFrame:
    """The first surface of each key in an order, and how many rows differ from it."""
    first = df.groupBy(*keys).agg(F.min_by(surface, F.struct(*order)).alias("_first"))
    out = df.join(first, keys).groupBy(*keys, "_first").agg(F.count_if(F.col(surface) != F.col("_first")).alias("n_differing"))
    return out.withColumnRenamed("_first", surface)


def compression(df: DataFrame, raw: str, compressed: str) -> DataFrame:
    """Positions before and after, their ratio and what was saved."""
    out = df.agg(F.sum(raw).alias("raw"), F.sum(compressed).alias("compressed"))
    return out.withColumn("removed", F.col("raw") - F.col("compressed")).withColumn("ratio", F.try_divide(F.col("compressed"), F.col("raw")))


def shared_prefix(df: DataFrame, key: str, ids: str) -> DataFrame:
    """Length of the common prefix and suffix of each key's sequences."""
    def common(order: Column) -> DataFrame:
        places = df.select(key, F.size(ids).alias("n"), F.posexplode_outer(order))
        each = places.groupBy(key, "pos").agg(F.count_distinct("col").alias("kinds"), F.count("col").alias("rows"))
        size = df.groupBy(key).agg(F.count("*").alias("all"), F.min(F.size(ids)).alias("least"))
        odd = each.join(size, key).where((F.col("kinds") > 1) | (F.col("rows") < F.col("all"))).groupBy(key).agg(F.min("pos").alias("at"))
        return size.join(odd, key, "left").select(key, F.coalesce("at", "least").alias("n"))

    return common(F.col(ids)).withColumnRenamed("n", "prefix").join(common(F.reverse(ids)).withColumnRenamed("n", "suffix"), key)


def runs(stream: DataFrame, ids: str, most: int, *keep: str) -> DataFrame:
    """(kept columns, pos, token_ids) of every run of 1 to `most` elements of a stream; a row's array isn't copied to its places."""
    of = lambda n: F.filter(F.transform(ids, lambda _, p: F.struct(p.alias("pos"), F.slice(F.col(ids), p + 1, F.lit(n)).alias("token_ids"))), lambda r: F.size(r["token_ids"]) == n)
    return stream.select(*keep, F.inline(F.concat(*map(of, range(1, most + 1)))))


def longest_prefix_entries(stream: DataFrame, entries: DataFrame, key: str, ids: str, most: int) -> DataFrame:
    """For every place of a stream, the longest entry whose token_ids start there: an equi-join of runs.

    Entries grow with the corpus that they come from: they are sorted and merged on the executors, never broadcast.
    """
    hits = runs(stream, ids, most, key).join(entries.hint("merge"), "token_ids")
    return hits.groupBy(key, "pos").agg(F.max(F.struct(F.size("token_ids").alias("n"), "entry")).alias("m")).select(key, "pos", "m.n", "m.entry")


#: Rows in a range of sorted places, and elements that places are first sorted by.
RANGE, WIDTH = 1 << 15, 8


def _shared_lengths(places: DataFrame, least: int) -> DataFrame:
    """(tid, pos, size, n): of places whose runs `s` come from `w` equal rows, the longest beginning that `least` of all have.

    In the order of the runs those with the same beginning stand together, so that the least - 1 neighbours on each
    side tell. Ranges of the order are of one size, whatever the runs are, and overlap by those neighbours.
    """
    ranked = Tables(places.sparkSession, "places").keep(renumbered(places, "s", "rank"), "ranked")
    own, at = F.floor(F.col("rank") / RANGE), F.col("rank") % RANGE
    near = F.array_compact(F.array(own, F.when(at < least - 1, own - 1), F.when(at > RANGE - least, own + 1)))
    order = Window.partitionBy("range").orderBy("rank")
    rows = ranked.select("*", F.explode(near).alias("range"))
    rows = rows.withColumn("l", F.coalesce(common_prefix(F.lag("s").over(order), F.col("s")), F.lit(0)))
    kept = rows.select("*", *(F.lag("w", i).over(order).alias(f"w_{i}") for i in range(1, least)), *(F.lead("w", i).over(order).alias(f"w{i}") for i in range(1, least)), *(F.lag("l", i).over(order).alias(f"l_{i}") for i in range(1, least)), *(F.lead("l", i).over(order).alias(f"l{i}") for i in range(1, least))).where(F.col("range") == own)

    def beginning(before: int, behind: int) -> Column:
        """What a row shares with so many rows before and behind it, if they are enough."""
        weight = sum((F.col(c) for c in (*(f"w_{i}" for i in range(1, before + 1)), *(f"w{i}" for i in range(1, behind + 1)))), F.col("w"))
        shared = [F.size("s"), *(F.col("l") if i == 0 else F.col(f"l_{i}") for i in range(before)), *(F.col(f"l{i}") for i in range(1, behind + 1))]
        return F.when(weight >= least, F.least(*shared) if len(shared) > 1 else shared[0])

    n = F.greatest(F.lit(0), *(beginning(a, b) for a in range(least) for b in range(least - a)))
    return kept.select("tid", "pos", "size", n.cast("int").alias("n"))


def longest_recurring(stream: DataFrame, key: str, ids: str, least: int) -> DataFrame:
    """(key, pos, n, run): at every place of a stream the longest run, however long, that starts at `least` places of all rows.

    Equal rows are one that counts as often. Places are sorted by their first elements; those whose run may be longer are
    sorted again by four times as many, until none is left: the work follows the length of what is found.
    """
    tables = Tables(stream.sparkSession, "recurring")
    whole = stream.where(F.size(ids) > 0).select(F.col(key).alias("k"), F.col(ids).alias("ids"))
    texts = tables.keep(whole.groupBy("ids").agg(F.count("*").alias("w")).withColumn("tid", F.monotonically_increasing_id()), "texts")
    rows = tables.keep(whole.join(texts.select("ids", "tid").hint("merge"), "ids").select("k", "tid"), "rows")
    places, width, done = texts.select("tid", "w", "ids", F.explode(F.sequence(F.lit(0), F.size("ids") - 1)).alias("pos")), WIDTH, []
    while True:
        cut = places.select("tid", "w", "pos", (F.size("ids") - F.col("pos")).alias("size"), F.slice("ids", F.col("pos") + 1, F.lit(width)).alias("s"))
        # What is sorted again has a run already, also where all that go on with it are too few.
        known = F.greatest("n", F.lit(0 if width == WIDTH else width // 4)).alias("n")
        found = tables.keep(_shared_lengths(cut, least).select("tid", "pos", "size", known).where("n > 0"), f"found-{width}")
        longer = (F.col("n") == width) & (F.col("size") > width)
        done.append(found.where(~longer).select("tid", "pos", "n"))
        if found.where(longer).isEmpty():
            break
        places, width = found.where(longer).select("tid", "pos").join(texts.hint("merge"), "tid"), 4 * width
    every = functools.reduce(DataFrame.union, done)
    # Rows of one key are one, and take the longest; the runs themselves are cut out last, and never shuffled.
    best = rows.join(every.hint("merge"), "tid").groupBy("k", "pos").agg(F.max(F.struct("n", "tid")).alias("m")).select("k", "pos", "m.n", "m.tid")
    return best.join(texts.select("ids", "tid").hint("merge"), "tid").select(F.col("k").alias(key), "pos", "n", F.slice("ids", F.col("pos") + 1, F.col("n")).alias("run"))
