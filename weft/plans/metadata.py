"""What a vocabulary decomposes into: bases, identity entries, survivors and the bytes that modifiers add."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import affixes
from weft.operators.corpus import first_wins
from weft.operators.metrics import collisions
from weft.plans.composition import GROUPS


def byte_alphabet() -> dict[int, str]:
    """The reversible printable stand-ins of the 256 bytes: printable ones stand for themselves, the rest follow from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return {b: chr(b if b in plain else next(spare)) for b in range(256)}


def decomposed(vocabulary: DataFrame, id_col: str, surface: str) -> DataFrame:
    """(id, surface, base, base_key): every token's canonical base; tokens without one are left out."""
    stripped = affixes.strip_affixes(vocabulary.select(id_col, surface), surface)
    # The generator keeps the optimizer from copying the whole chain of affixes into whatever uses the base.
    stripped = stripped.select(id_col, surface, F.explode(F.array("base")).alias("base"))
    return stripped.withColumn("base_key", affixes.space_cap_base(F.col("base"))).where(F.coalesce(F.col("base_key"), F.lit("")) != "")


#: What a surface is decomposed into besides its base.
MODIFIERS = ("space_prefix", "prefix_punct", "prep", "prep_cap", "article", "article_cap", "suffix_punct", "capitalization")


def surface_collisions(surfaces: DataFrame, surface: str) -> DataFrame:
    """Bases and modifiers that several different surfaces decompose to, with their number and the least of them."""
    stripped = affixes.strip_affixes(surfaces.select(surface), surface)
    # As above: the chain of affixes is worked out once.
    stripped = stripped.select(surface, F.explode(F.array(F.struct(*MODIFIERS[:-1], "base"))).alias("s")).select(surface, "s.*")
    keyed = stripped.withColumn("base_key", affixes.space_cap_base(F.col("base"))).withColumn("capitalization", affixes.capitalization(F.col("base")))
    return collisions(keyed.where(F.coalesce("base_key", F.lit("")) != ""), ["base_key", *MODIFIERS], surface)


def bases(vocabulary: DataFrame, id_col: str, surface: str) -> DataFrame:
    """Each base with its first token and its number of variants."""
    parts = decomposed(vocabulary, id_col, surface)
    first = first_wins(parts, ["base_key"], [id_col]).select("base_key", F.col(id_col).alias("first_id"))
    return first.join(parts.groupBy("base_key").agg(F.count_distinct(surface).alias("n_variants")), "base_key")


def survivors(vocabulary: DataFrame, id_col: str, surface: str, special: list[str] = ()) -> DataFrame:
    """Tokens that are their own base, and those that don't decompose; special ones never count."""
    plain = vocabulary.where(~F.col(surface).isin(list(special))) if special else vocabulary
    parts = decomposed(plain, id_col, surface)
    own = parts.where(F.col(surface) == F.col("base_key")).select(id_col)
    return own.union(plain.join(parts, id_col, "left_anti").select(id_col)).distinct()


def reachable(entries: DataFrame, disallowed: DataFrame | Callable[[Column], Column], ids: str = "token_ids") -> DataFrame:
    """Entries none of whose ids is disallowed: by a table (id), or by a condition that an id alone decides, which needs no join."""
    if callable(disallowed):
        return entries.where(~F.exists(ids, lambda i: F.coalesce(disallowed(i), F.lit(False))))
    bad = entries.select(ids, F.explode(ids).alias("id")).join(disallowed, "id", "left_semi").select(ids).distinct()
    return entries.join(bad, ids, "left_anti")


def passes(entries: list[DataFrame], keys: list[str]) -> DataFrame:
    """Passes of entries in order, a later one overwriting an earlier one with the same key."""
    every = None
    for n, df in enumerate(entries):
        one = df.withColumn("pass_no", F.lit(n))
        every = one if every is None else every.unionByName(one)
    return first_wins(every, keys, [F.desc("pass_no")]).drop("pass_no")


def whitespace_bridges(words: DataFrame, known: DataFrame, space_id: int) -> DataFrame:
    """[space, token] as the token with a space before it, unless the two are one token already."""
    joined = known.select(F.col("surface").alias("_s"))
    free = words.join(joined, F.concat(F.lit(" "), words["surface"]) == F.col("_s"), "left_anti")
    return free.select(F.array(F.lit(space_id), "id").alias("token_ids"), F.array("id").alias("base_ids"), F.lit("space_prefix").alias("group"))


def utf8_delta(row: Column) -> Column:
    """Bytes that a row of modifiers adds to its base: one for a space, those of its literals, one after each function word."""
    out = F.when(row[0] == 1, 1).otherwise(0)
    for g, extra in ((2, 1), (4, 1), (6, 0), (7, 0)):
        sizes = F.array(*(F.lit(len(v.encode()) + (extra if v else 0)) for v in GROUPS[g][1]))
        out = out + F.element_at(sizes, row[g].cast("int") + 1)
    return out


def default_indices(names: list[str]) -> list[int]:
    """Places of the values that mean none; the first if none of them does."""
    return [i for i, n in enumerate(names) if n.lower().startswith(("no_", "na_")) or n.lower() == "none"] or [0]
