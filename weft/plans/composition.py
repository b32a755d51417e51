"""Texts as base words with rows of modifiers, and back.

A unit is a word with what the modifiers can express round it: one leading space, prefix punctuation, a preposition
and a determiner before it with one space each, suffix punctuation after it, and its capitalization. A unit is
composed only if its modifiers give back exactly its characters; everything else stays literal, so that decoding
what was encoded is the identity.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.affixes import suffix_literals
from weft.functions.literals import ARTICLES, POSSESSIVE_DETERMINERS, PREFIX_PUNCTUATION, PREPOSITIONS

CAPS = ("none", "add", "add_all_caps", "remove")
#: Groups of modifiers and their values; value 0 changes nothing.
GROUPS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("space_prefix", ("", " ", "remove")),
    ("base_capitalization", CAPS),
    ("determiners", ("", *ARTICLES, *POSSESSIVE_DETERMINERS)),
    ("article_capitalization", ("", "add")),
    ("prepositions", ("", *PREPOSITIONS["core"])),
    ("prep_capitalization", ("", "add")),
    ("prefix_punctuation", ("", *PREFIX_PUNCTUATION)),
    ("suffix_punctuation", ("", *suffix_literals())),
)
SIZES = tuple(len(values) for _, values in GROUPS)
DEFAULT = (0,) * len(GROUPS)
_AT = [{v: i for i, v in enumerate(values)} for _, values in GROUPS]


def _any(literals) -> str:
    return "|".join(map(re.escape, sorted((x for x in literals if x), key=len, reverse=True)))


@functools.cache
def _unit() -> re.Pattern:
    prep, det = _any(PREPOSITIONS["core"]), _any(GROUPS[2][1])
    return re.compile(
        rf"(?P<space> ?)(?P<prefix>(?:{_any(PREFIX_PUNCTUATION)})?)(?:(?P<prep>(?i:{prep})) )?(?:(?P<det>(?i:{det})) )?"
        rf"(?P<word>[^\W\d_]+)(?P<suffix>(?:{_any(x for x in suffix_literals() if not x[0].isalpha())})?)(?![^\W\d_])"
    )


def _function_word(found: str | None, values: dict[str, int]) -> tuple[int, int] | None:
    if not found:
        return 0, 0
    low = found.lower()
    return (values[low], 0) if found == low else (values[low], 1) if found == low[0].upper() + low[1:] else None


def _capital(word: str) -> tuple[str, int] | None:
    low = word.lower()
    for state, made in ((0, low), (1, low[:1].upper() + low[1:]), (2, low.upper() if len(low) > 1 else "")):
        if made == word:
            return low, state
    return None


#: Units that a worker remembers.
REMEMBERED = 100_000
_known: dict[str, tuple[str, tuple[int, ...]]] = {}


def _parsed(m: re.Match) -> tuple[str, tuple[int, ...]]:
    """(base, modifiers) of a unit; the unit itself as a literal where modifiers can't give it back."""
    prep, det, cap = _function_word(m["prep"], _AT[4]), _function_word(m["det"], _AT[2]), _capital(m["word"])
    if prep is None or det is None or cap is None:
        return m[0], DEFAULT
    row = (len(m["space"]), cap[1], det[0], det[1], prep[0], prep[1], _AT[6][m["prefix"]], _AT[7][m["suffix"]])
    return (cap[0], row) if synthesize(cap[0], row) == m[0] else (m[0], DEFAULT)


def compose(text: str) -> list[tuple[str, tuple[int, ...]]]:
    """(base, modifiers) of a text, in order. A unit's parse rests on its own characters only, so it is remembered."""
    out: list[tuple[str, tuple[int, ...]]] = []
    at = 0
    for m in _unit().finditer(text):
        if m.start() > at:
            out.append((text[at : m.start()], DEFAULT))
        at = m.end()
        unit = m[0]
        found = _known.get(unit)
        if found is None:
            found = _parsed(m)
            if len(_known) < REMEMBERED and len(unit) <= 64:
                _known[unit] = found
        out.append(found)
    if at < len(text):
        out.append((text[at:], DEFAULT))
    return out


def synthesize(base: str, row: tuple[int, ...]) -> str:
    """The surface of a base word under its modifiers."""
    word = base[:1].upper() + base[1:] if row[1] == 1 else base.upper() if row[1] == 2 else base[:1].lower() + base[1:] if row[1] == 3 else base
    parts = []
    for value, capital, group in ((row[4], row[5], 4), (row[2], row[3], 2)):
        if value:
            w = GROUPS[group][1][value]
            parts.append(w[0].upper() + w[1:] if capital else w)
    core = " ".join([*parts, word])
    return (" " if row[0] == 1 else "") + GROUPS[6][1][row[6]] + core + GROUPS[7][1][row[7]]


def decompose(units: list[tuple[str, tuple[int, ...]]]) -> str:
    return "".join(synthesize(base, row) if any(row) else base for base, row in units)


def longest_matches(ids: list[int], entries: dict[tuple[int, ...], tuple[list[int], list[tuple[int, ...]]]], default: tuple[int, ...]) -> tuple[list[int], list[tuple[int, ...]]]:
    """Greedy composition of an id stream: at each place the longest entry, else the id itself with the default row."""
    most = max(map(len, entries), default=0)
    out_ids: list[int] = []
    rows: list[tuple[int, ...]] = []
    at = 0
    while at < len(ids):
        for n in range(min(most, len(ids) - at), 0, -1):
            if (hit := entries.get(tuple(ids[at : at + n]))) is not None:
                out_ids += hit[0]
                rows += hit[1]
                at += n
                break
        else:
            out_ids.append(ids[at])
            rows.append(default)
            at += 1
    return out_ids, rows


def merged_rows(rows: list[tuple[int, ...]], default: tuple[int, ...] = DEFAULT) -> tuple[int, ...]:
    """One row of several: in each group the last value that isn't the default."""
    return tuple(next((r[g] for r in reversed(rows) if r[g] != default[g]), default[g]) for g in range(len(default)))


def composed(docs: DataFrame, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, n_units, n_words, n_active, n_multi, usage, round_trip) of every text, encoded and decoded in one pass.

    n_words: pieces of the same text without composition (words, function words, marks and spaces apart).
    """
    plain = re.compile(r" ?[^\W\d_]+|\d{1,2}|[^\s\w]+|\s|_")
    names = ["n_units", "n_words", "n_active", "n_multi", "usage", "round_trip"]
    schema = docs.select(key, *keep, *(F.lit(0).cast("long").alias(n) for n in names[:4]), F.array(F.lit(0).cast("long")).alias("usage"), F.lit(True).alias("round_trip")).schema

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in names]
            for x in b.column(b.num_columns - 1):
                t = x.as_py() or ""
                units = compose(t)
                rows = Counter(r for _, r in units)
                active = sum(n for r, n in rows.items() if any(r))
                multi = sum(n for r, n in rows.items() if len(r) - r.count(0) > 1)
                usage = [sum(n for r, n in rows.items() if r[g]) for g in range(len(GROUPS))]
                literal = sum(len(plain.findall(base)) for base, r in units if not any(r))
                for column, v in zip(out, (active + literal, len(plain.findall(t)), active, multi, usage, decompose(units) == t)):
                    column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, k) for c, k in zip(out, kinds))], names=[key, *keep, *names])

    return docs.select(key, *keep, text).mapInArrow(run, schema)


def global_index(rel: Column, sizes=SIZES):
    """Group-relative values as places in one vector over all groups."""
    starts = [sum(sizes[:g]) for g in range(len(sizes))]
    return F.transform(rel, lambda v, g: v + F.element_at(F.array(*map(F.lit, starts)), (g + 1).cast("int")))
