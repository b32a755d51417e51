"""Affixes of a surface and its capitalization, as ordered chains of built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.literals import ARTICLES, MOJIBAKE, POSSESSIVES, PREFIX_PUNCTUATION, PREPOSITIONS, SUFFIX_PAIRS, SUFFIX_POSSESSIVES, SUFFIX_SINGLES


def _first(text: Column, literals: Sequence[str], hit) -> Column:
    out = None
    for x in literals:
        out = F.when(hit(x), F.lit(x)) if out is None else out.when(hit(x), F.lit(x))
    return out


def suffix_literals(possessives: bool = True) -> tuple[str, ...]:
    return SUFFIX_PAIRS + (SUFFIX_POSSESSIVES if possessives else ()) + SUFFIX_SINGLES


def prefix_punctuation(text: Column) -> Column:
    """The first literal that the text starts with, null if none does."""
    return _first(text, PREFIX_PUNCTUATION, lambda x: F.startswith(text, F.lit(x)))


def suffix_punctuation(text: Column, possessives: bool = True) -> Column:
    return _first(text, suffix_literals(possessives), lambda x: F.endswith(text, F.lit(x)))


def possessive(text: Column) -> Column:
    return _first(text, POSSESSIVES, lambda x: F.endswith(text, F.lit(x)))


def leading_word(text: Column, literals: Sequence[str]) -> Column:
    """The longest literal that, followed by a space, starts the text in any case."""
    return _first(text, sorted(literals, key=len, reverse=True), lambda x: F.startswith(F.lower(text), F.lit(f"{x} ")))


def determiner(text: Column, literals: Sequence[str] = ARTICLES) -> Column:
    return leading_word(text, literals)


def preposition(text: Column, profile: str = "core") -> Column:
    return leading_word(text, PREPOSITIONS[profile])


def after(text: Column, found: Column, extra: int = 0) -> Column:
    """What follows a found prefix (and `extra` more code points)."""
    return F.when(found.isNull(), text).otherwise(F.substr(text, F.length(found) + 1 + extra))


def before(text: Column, found: Column) -> Column:
    """What precedes a found suffix."""
    return F.when(found.isNull(), text).otherwise(F.substr(text, F.lit(1), F.length(text) - F.length(found)))


def strip_affixes(df, text: str, determiners: Sequence[str] = ARTICLES, profile: str = "core"):
    """`df` with space_prefix, prefix_punct, prep, prep_cap, article, article_cap, suffix_punct and base of a text column.

    Order: one space, prefix punctuation, preposition, determiner, suffix punctuation.
    """
    t = F.col("_t")
    df = df.withColumn("space_prefix", F.startswith(F.col(text), F.lit(" ")))
    df = df.withColumn("_t", F.when(F.col("space_prefix"), F.substr(F.col(text), F.lit(2))).otherwise(F.col(text)))
    df = df.withColumn("prefix_punct", prefix_punctuation(t)).withColumn("_t", after(t, F.col("prefix_punct")))
    for name, found in (("prep", preposition(t, profile)), ("article", determiner(t, determiners))):
        df = df.withColumn(name, found)
        df = df.withColumn(f"{name}_cap", F.col(name).isNotNull() & F.substring(t, 1, 1).rlike(r"\p{Lu}")).withColumn("_t", after(t, F.col(name), 1))
    df = df.withColumn("suffix_punct", suffix_punctuation(t)).withColumn("base", before(t, F.col("suffix_punct")))
    return df.drop("_t")


def capitalization(text: Column) -> Column:
    """none, first_cap, all_caps (more than one letter, all upper) or all_caps_literal (other mixtures with capitals)."""
    letters = F.regexp_replace(text, r"\P{L}", "")
    upper = F.length(letters) - F.length(F.regexp_replace(letters, r"\p{Lu}", ""))
    first = F.substring(letters, 1, 1).rlike(r"\p{Lu}")
    return (
        F.when(upper == 0, "none")
        .when((upper == F.length(letters)) & (upper > 1), "all_caps")
        .when(first & (upper == 1), "first_cap")
        .otherwise("all_caps_literal")
    )


def with_capitalization(text: Column, state: Column) -> Column:
    """The text in a state: upper case, first letter capital and the rest lower, lower case, or unchanged."""
    capital = F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))
    return F.when(state == "all_caps", F.upper(text)).when(state == "first_cap", capital).when(state == "none", F.lower(text)).otherwise(text)


def space_cap_base(text: Column) -> Column:
    """Without leading spaces and, but for all-caps ones, in lower case; null for a text of spaces."""
    bare = F.ltrim(text)
    letters = F.regexp_replace(bare, r"\P{L}", "")
    caps = (F.length(letters) > 0) & ~letters.rlike(r"\P{Lu}")
    return F.when(F.length(bare) == 0, None).when(caps, bare).otherwise(F.lower(bare))


def accuracy_surface(text: Column) -> Column:
    """`space_cap_base` of texts that hold letters only, null for others."""
    return F.when(F.ltrim(text).rlike(r"^\p{L}+$"), space_cap_base(text))


def change_first_letter(text: Column, upper: bool) -> Column:
    """The first alphabetic character in upper or lower case."""
    head, letter, tail = (F.regexp_extract(text, r"(?s)^(\P{L}*)(\p{L})(.*)$", i) for i in (1, 2, 3))
    return F.when(text.rlike(r"\p{L}"), F.concat(head, F.upper(letter) if upper else F.lower(letter), tail)).otherwise(text)


def camel_parts(text: Column) -> Column:
    """Parts between a small and a capital letter, and before the last capital of a run that a small one follows."""
    return F.split(text, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})")


def canonical_punctuation(text: Column) -> Column:
    """Trimmed, garbled quotation marks and dashes put right."""
    out = F.trim(text)
    for bad, good in MOJIBAKE:
        out = F.replace(out, F.lit(bad), F.lit(good))
    return out


def variants(text: Column) -> Column:
    """Array of the surfaces that differ from a text by a leading space or its capitalization, with what changes them."""
    def one(space: bool, state: str) -> Column:
        surface = with_capitalization(text, F.lit(state))
        return F.struct((F.concat(F.lit(" "), surface) if space else surface).alias("variant"), F.lit(space).alias("space"), F.lit(state).alias("state"))

    every = F.array(*(one(space, state) for space in (False, True) for state in ("none", "first_cap", "all_caps")))
    return F.filter(every, lambda v: v["variant"] != text)
