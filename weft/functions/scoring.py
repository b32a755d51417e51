"""Answer normalization, matching and extraction, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.literals import ASCII_PUNCTUATION

WS = r"[\p{Z}\x09-\x0D\x85\x1C-\x1F]+"


def fold_spaces(text: Column) -> Column:
    """Runs of white space as one space, none at the ends; null as an empty text."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WS, " "))


def squad_normalized(text: Column) -> Column:
    """Lower case, without ASCII punctuation and the words a, an, the, spaces folded."""
    bare = F.translate(F.lower(F.coalesce(text, F.lit(""))), ASCII_PUNCTUATION, "")
    # Letters, numbers and the underscore make words here; Java's own boundary would count marks and not all numbers.
    return fold_spaces(F.regexp_replace(bare, r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " "))


def answer_normalized(text: Column, qa_style: bool) -> Column:
    return squad_normalized(fold_spaces(text)) if qa_style else fold_spaces(text)


def em_match(prediction: Column, answers: Column, kind: str = "prefix", qa_style: bool = False) -> Column:
    """Whether a prediction equals, starts with or contains one of the answers; empty ones never match."""
    p = answer_normalized(prediction, qa_style)
    test = {"exact": lambda a: p == a, "prefix": lambda a: F.startswith(p, a), "contains": lambda a: F.contains(p, a)}[kind]
    hits = F.exists(F.transform(answers, lambda a: answer_normalized(a, qa_style)), lambda a: (a != "") & test(a))
    return (p != "") & F.coalesce(hits, F.lit(False))


def first_line(text: Column) -> Column:
    """The first line that isn't blank, trimmed; empty if there is none."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(?U)(\S(?:[^\n\r\x0B\x0C\x1C-\x1E\x85  ]*\S)?)", 1)


def first_word(text: Column) -> Column:
    """First word of the first line without punctuation at its ends."""
    return F.btrim(F.regexp_extract(first_line(text), r"(?U)^(\S*)", 1), F.lit(ASCII_PUNCTUATION))


def first_number(text: Column) -> Column:
    """The first number without its commas; null if there is none."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"([-+]?[0-9][0-9,]*(?:\.[0-9]+)?)", 1)
    return F.nullif(F.replace(found, F.lit(","), F.lit("")), F.lit(""))


def final_number(text: Column) -> Column:
    """The number after the mark of a worked answer (four hashes); null if there is none."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"####\s*(-?[0-9.,]+)", 1)
    return F.nullif(F.trim(F.replace(found, F.lit(","), F.lit(""))), F.lit(""))


def code_block(text: Column) -> Column:
    """The first fenced block, else the whole text, trimmed."""
    fenced = r"(?s)```(?:python)?\s*\n(.*?)\n```"
    return F.trim(F.when(text.rlike(fenced), F.regexp_extract(text, fenced, 1)).otherwise(text))


def cut_at_stops(text: Column, stops: list[str]) -> Column:
    """The text before the earliest stop string."""
    places = [F.nullif(F.locate(s, text), F.lit(0)) for s in stops if s]
    if not places:
        return text
    at = F.least(*places, F.lit(None).cast("int"))
    return F.when(at.isNull(), text).otherwise(F.substr(text, F.lit(1), at - 1))


def task_match(label: Column, prediction: Column, answers: Column) -> Column:
    """Exact-match rule by task: first word, first number, worked answer, else the first line by prefix."""
    line = first_line(prediction)
    number = first_number(line)
    worked = F.coalesce(final_number(line), number, line)
    return (
        F.when(label == "LAMBADA", em_match(first_word(prediction), answers, "exact"))
        .when((label == "Arithmetic") & number.isNotNull(), em_match(number, F.transform(answers, lambda a: F.coalesce(first_number(a), a)), "exact"))
        .when(label == "GSM8K", em_match(worked, answers, "exact"))
        .otherwise(em_match(line, answers, "prefix"))
    )


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """1 - C(n-c, k) / C(n, k), as a product; 0 without a correct sample, 1 if fewer than k are wrong."""
    terms = F.sequence(n - c + 1, n)
    missed = F.aggregate(terms, F.lit(1.0), lambda p, i: p * (F.lit(1.0) - k / i))
    return F.when((n <= 0) | (c <= 0), 0.0).when(n - c < k, 1.0).otherwise(1 - missed)
