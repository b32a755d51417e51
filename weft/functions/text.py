"""Corpus text functions: cropping, case normalization and pre-tokens, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.literals import BASELINE_PATTERN, ISOLATING_PATTERN, STAGE2_PATTERN, WORD

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def crop(text: Column, n: int) -> Column:
    """The first n code points; all of them for n <= 0."""
    return F.substring(text, 1, n) if n > 0 else text


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def each_word(text: Column, change) -> Column:
    """The text with every word (ASCII letters, joined by inner hyphens and apostrophes) replaced by `change(word)`."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    gaps = F.split(text, WORD, -1)
    return F.array_join(F.zip_with(gaps, words, lambda g, w: F.concat(g, F.coalesce(change(w), F.lit("")))), "")


def lower_first_letters(text: Column) -> Column:
    return each_word(text, lambda w: F.concat(ascii_lower(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))


def lower_all_letters(text: Column) -> Column:
    """Every ASCII letter stands in a word, so this needs no split."""
    return ascii_lower(text)


def lower_except_all_caps(text: Column) -> Column:
    """Words like Title are lower-cased; ALL-CAPS, one-letter capitals and mIxEd ones stay."""
    titled = r"^[A-Z](?=[^A-Z]*[a-z])[^A-Z]*$"
    return each_word(text, lambda w: F.when(w.rlike(titled), ascii_lower(w)).otherwise(w))


PREPROCESSORS = {
    "identity": lambda text: text,
    "first_letter": lower_first_letters,
    "all_letters": lower_all_letters,
    "except_all_caps": lower_except_all_caps,
}


def preprocessed(text: Column, algorithm: str = "baseline", policy: str = "except_all_caps") -> Column:
    """The text as the trainer sees it: unchanged for the baseline, case-normalized for the space-and-capitals one."""
    if algorithm == "baseline":
        return text
    if algorithm != "space_cap" or policy not in PREPROCESSORS:
        raise ValueError(f"unknown algorithm or policy: {algorithm}, {policy}")
    return PREPROCESSORS[policy](text)


PATTERNS = {"baseline": BASELINE_PATTERN, "isolating": ISOLATING_PATTERN, "stage2": STAGE2_PATTERN}


def pretokens(text: Column, pattern: str = "isolating") -> Column:
    """Array of chunks that together are the text; classes are Unicode's."""
    return F.regexp_extract_all(text, F.lit("(?U)" + PATTERNS[pattern]), F.lit(0))
