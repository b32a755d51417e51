"""Predicates and rewrites of surfaces, and the transformation names that describe them, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.literals import PREPOSITIONS
from weft.functions.scoring import squad_normalized

#: Names of the transformations of space and capitals.
ACTIVE_TRANSFORMS = ("with_space_prefix", "remove_space_prefix", "add_base_capitalization", "add_all_caps_base_capitalization", "remove_base_capitalization")
#: Tasks whose answers are compared after normalization.
NORMALIZED_TASKS = ("squad", "coqa")


def letters(text: Column) -> Column:
    return F.regexp_replace(text, r"\P{L}", "")


def any_active(transforms: Column) -> Column:
    """Whether an array of transformation names holds one that changes space or capitals."""
    return F.arrays_overlap(transforms, F.array(*map(F.lit, ACTIVE_TRANSFORMS)))


def cap_representable(text: Column) -> Column:
    """No letters, all small, or the first a capital and the rest small."""
    return letters(text).rlike(r"^(\p{Lu}?\p{Ll}*)$")


def first_letter_upper(text: Column) -> Column:
    """Whether the first letter is a capital; null without letters."""
    return F.when(letters(text) == "", None).otherwise(F.substring(letters(text), 1, 1).rlike(r"\p{Lu}"))


def like_first_letter(text: Column, model: Column) -> Column:
    """A text whose first character has the case of the model's first character."""
    rest = F.substr(text, F.lit(2))
    return F.when(F.substring(model, 1, 1).rlike(r"\p{Lu}"), F.concat(F.upper(F.substring(text, 1, 1)), rest)).otherwise(F.concat(F.lower(F.substring(text, 1, 1)), rest))


def without_capital_runs(parts: Column) -> Column:
    """Parts of a word with those of several capitals taken apart into letters."""
    return F.flatten(F.transform(parts, lambda p: F.when(p.rlike(r"^\p{Lu}{2,}$"), F.filter(F.split(p, ""), lambda c: c != "")).otherwise(F.array(p))))


def mixes_line_space(text: Column) -> Column:
    """White space other than the space, next to other characters: such a token is never matched as a part."""
    return text.rlike(r"[\t\n\x0B\f\r]") & text.rlike(r"[^\s]")


def normalization_policy(task: Column) -> Column:
    return F.when(F.lower(F.trim(F.coalesce(task, F.lit("")))).isin(*NORMALIZED_TASKS), "squad_qa").otherwise("none")


def for_policy(text: Column, policy: Column) -> Column:
    """A text as the policy compares it; null as an empty one."""
    return F.when(policy == "squad_qa", squad_normalized(text)).otherwise(F.coalesce(text, F.lit("")))


def normalized_list(words: Column) -> Column:
    """Trimmed, in lower case, without empty ones, each once in order of first occurrence."""
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.lower(F.trim(w))), lambda w: w != ""))


def preposition_profile(words: Column) -> Column:
    """The profile that a normalized list is, in whatever order; custom if it is none."""
    out = None
    for name, own in PREPOSITIONS.items():
        same = F.sort_array(words) == F.array(*map(F.lit, sorted(own)))
        out = F.when(same, name) if out is None else out.when(same, name)
    return out.otherwise("custom")


def relative_transforms(space: Column, state: Column, own_space: Column, own_state: Column) -> Column:
    """Names of what turns a surface of its own space and capitals into a variant of others."""
    spaces = F.when(space == own_space, "no_space_prefix").when(space, "with_space_prefix").otherwise("remove_space_prefix")
    caps = F.when(state == own_state, "no_base_capitalization").when(state == "none", "remove_base_capitalization").when(state == "all_caps", "add_all_caps_base_capitalization")
    return F.array(spaces, caps.otherwise("add_base_capitalization"))


def complete_transforms(stripped: dict[str, Column]) -> Column:
    """One name of every group for a stripped surface: what it has, or that it has none."""
    def literal(kind: str, none: str) -> Column:
        return F.when(stripped[kind].isNull(), none).otherwise(F.concat(F.lit(f"{kind}_"), stripped[kind]))

    caps = F.when(stripped["capitalization"] == "first_cap", "add_base_capitalization").when(stripped["capitalization"] == "all_caps", "add_all_caps_base_capitalization")
    return F.array(
        F.when(stripped["space_prefix"], "with_space_prefix").otherwise("no_space_prefix"),
        caps.otherwise("no_base_capitalization"),
        literal("article", "no_article"),
        F.when(stripped["article_cap"], "add_article_capitalization").otherwise("no_article_capitalization"),
        literal("prep", "no_preposition"),
        F.when(stripped["prep_cap"], "add_prep_capitalization").otherwise("no_prep_capitalization"),
        literal("prefix_punct", "no_prefix_punctuation"),
        literal("suffix_punct", "no_suffix_punctuation"),
    )


def global_indices(row: Column, sizes: list[int]) -> Column:
    """A row of values within groups as places among all values."""
    starts = F.array(*(F.lit(sum(sizes[:g])) for g in range(len(sizes))))
    return F.zip_with(row, starts, lambda v, s: v + s)


def relative_row(places: Column, sizes: list[int]) -> Column:
    """The way back from `global_indices`."""
    starts = F.array(*(F.lit(sum(sizes[:g])) for g in range(len(sizes))))
    return F.zip_with(places, starts, lambda v, s: v - s)


def one_hot(row: Column, sizes: list[int]) -> Column:
    """All values as 0 and 1."""
    places = global_indices(row, sizes)
    return F.transform(F.sequence(F.lit(0), F.lit(sum(sizes) - 1)), lambda i: F.array_contains(places, i).cast("int"))


def lossy_bytes(token: Column) -> Column:
    """Bytes of a token's text once decoded: what isn't UTF-8 counts as the replacement character."""
    return F.octet_length(F.when(F.is_valid_utf8(token.cast("string")), token.cast("string")).otherwise(F.make_valid_utf8(token.cast("string"))))
