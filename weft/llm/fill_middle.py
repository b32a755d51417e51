"""Fill-in-middle by succinct rank and select over packed bit vectors.

A slab of texts gives two bit vectors over its bytes: one marks the last byte of every token, the other the first byte
of every character. Both are packed 64 bits to a word, with a directory of the ones before each block of words. Ranks
at the two ends of a text give its number of tokens, selection of two ranks gives the bytes at which it is cut, and
ranks of characters give the lengths of what lies between.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.words import IS_WORD, bytes_of, slabs

#: Words of a block of the directory.
BLOCK = 8
#: Marks of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")


class Bits:
    """A packed bit vector with a directory of its ones, a running total for each block of words."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros((len(packed) // (8 * BLOCK) + 1) * BLOCK, "<u8")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words.reshape(-1, BLOCK)
        self.within = np.cumsum(np.bitwise_count(self.words), axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(self.within[:, -1])])

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Ones before each place; a place may be one past the end."""
        word = place >> 6
        block, at = word // BLOCK, word % BLOCK
        whole = np.where(at > 0, self.within[block, np.maximum(at, 1) - 1], 0)
        below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + whole + np.bitwise_count(self.words[block, at] & below)

    def select(self, nth: np.ndarray) -> np.ndarray:
        """Place of the nth one of all, from 0."""
        block = np.searchsorted(self.before, nth, "right") - 1
        left = nth - self.before[block]
        at = (self.within[block] <= left[:, None]).sum(1)
        left = left - np.where(at > 0, self.within[block, np.maximum(at, 1) - 1], 0)
        bits = np.unpackbits(self.words[block, at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return (block * BLOCK + at) * 64 + (np.cumsum(bits, axis=1) > left[:, None]).argmax(1)


def token_ends(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether each byte is the last of a token: blanks with the word that follows them, or blanks at a text's end."""
    word = IS_WORD[data]
    out = np.zeros(len(data), bool)
    out[:-1] = word[:-1] & ~word[1:]
    # Where a text ends, a token does; where it doesn't, a word of this text and a blank of the next can't meet.
    out[places[1:][places[1:] > places[:-1]] - 1] = True
    return out


def _transformer(seed: str, percent: int, spm_percent: int, markers: tuple[str, str, str]):
    marks = [m.encode() for m in markers]
    p_mark, s_mark, m_mark = marks

    def run(batches):
        for whole in batches:
            for b in slabs(whole, 1):
                data, places = bytes_of(b.column(1))
                tokens, chars = Bits(token_ends(data, places)), Bits((data & 0xC0) != 0x80)
                before = tokens.rank(places)
                n = np.diff(before)
                keys = ["" if i is None else str(i) for i in b.column(0).to_pylist()]
                h = np.array([[int(d[x : x + 8], 16) for x in (0, 8, 16, 24)] for d in (hashlib.sha256(f"{seed}:{k}".encode()).hexdigest() for k in keys)], np.int64)
                ranks = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
                cuts = np.empty((len(n), 2), np.int64)
                for j in (0, 1):
                    cuts[:, j] = places[:-1]
                    some = np.flatnonzero(ranks[:, j] > 0)
                    cuts[some, j] = tokens.select(before[some] + ranks[some, j] - 1) + 1
                sizes = np.diff(np.column_stack([chars.rank(places[:-1]), chars.rank(cuts[:, 0]), chars.rank(cuts[:, 1])]), axis=1)
                raw, forms, outputs = data.tobytes(), [], []
                for i in range(len(n)):
                    lo, hi = places[i], places[i + 1]
                    text = raw[lo:hi]
                    if lo == hi or h[i, 2] % 100 >= percent or any(m in text for m in marks):
                        forms.append("plain")
                        outputs.append(text)
                        continue
                    prefix, middle, suffix = raw[lo : cuts[i, 0]], raw[cuts[i, 0] : cuts[i, 1]], raw[cuts[i, 1] : hi]
                    spm = h[i, 3] % 100 < spm_percent
                    forms.append("spm" if spm else "psm")
                    outputs.append(b"".join([s_mark, suffix, p_mark, prefix, m_mark, middle] if spm else [p_mark, prefix, s_mark, suffix, m_mark, middle]))
                plain = np.array([f == "plain" for f in forms], bool)
                columns = [b.column(0), pa.array(n), pa.array(forms, pa.string()), *(pa.array(sizes[:, j], mask=plain) for j in (0, 1)), pa.array(outputs, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def filled(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: str = "42",
    percent: int = 50,
    spm_percent: int = 80,
    markers: tuple[str, str, str] = MARKERS,
) -> DataFrame:
    """A row per row of `docs`: doc_id, n (tokens), form, prefix_chars, middle_chars and the transformed text as output.

    The id's hash draws two ranks among a text's tokens, whether it is transformed (`percent`) and into which order
    (`spm_percent`: suffix, prefix, middle; else prefix, suffix, middle). Prefix, middle and suffix may be empty. A
    null text is an empty one; empty texts and texts that contain a marker stay plain, with null lengths. A null id
    hashes as no digits; rows that repeat an id draw alike. An empty table gives no rows, and columns of whatever
    other names are not read. A long text is cut as a whole.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_transformer(seed, percent, spm_percent, markers), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of; markers start and end with characters that no cut can complete to another."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in markers), -1)
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)


#: The same in DuckDB, over `documents`, with the parameters' defaults, and digests in place of the texts.
SQL = r"""
with docs as (
  select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(doc_id::varchar, '')) as d,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u
  from documents),
drawn as (
  select *, len(u)::bigint as n, ('0x' || substr(d, 1, 8))::bigint as h1, ('0x' || substr(d, 9, 8))::bigint as h2,
         ('0x' || substr(d, 17, 8))::bigint as h3, ('0x' || substr(d, 25, 8))::bigint as h4 from docs),
cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain'
              when h4 % 100 < 80 then 'spm' else 'psm' end as form from drawn),
parts as (
  select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s from cut)
select doc_id, n, form, case when form <> 'plain' then length(p)::bigint end as prefix_chars,
       case when form <> 'plain' then length(m)::bigint end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
                        else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(t) as restored_sha256
from parts
"""
