"""Token counts of the sections of a text by offset-mapped attribution.

A text is encoded once, as a whole. Each token is mapped to the characters that it spans, an interval join lays
those spans over the spans of the sections, and a token that crosses a boundary goes by an explicit rule: to the
section of its first character ("first"), of its last ("last"), or to the one that holds most of its characters,
the earlier on a tie ("most"). A token of part of a character's bytes spans that character.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("first", "last", "most")
#: Rows of a batch that a worker gives back at once.
ROWS = 1024


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_loaded: dict[str, tuple] = {}


def encoder(vocabulary: str):
    """(encoding, byte length of each id)."""
    if vocabulary not in _loaded:
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            sizes[i] = len(token)
        _loaded[vocabulary] = (tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes)
    return _loaded[vocabulary]


def token_spans(text: str, vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """(first character, one past the last) of every token of the whole text, in order."""
    encoding, sizes = encoder(vocabulary)
    ends = np.cumsum(sizes[np.fromiter(encoding.encode_ordinary(text), np.int64)])
    if text.isascii():
        return ends - np.diff(ends, prepend=0), ends
    # The character of each byte: bytes that continue one belong to the character before them.
    char = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1
    return char[ends - np.diff(ends, prepend=0)], char[ends - 1] + 1


def attributed(start: np.ndarray, end: np.ndarray, sections: np.ndarray, rule: str = "first") -> tuple[np.ndarray, int]:
    """Tokens of each section and how many tokens cross a boundary; section i is the characters from sections[i] to sections[i + 1].

    sections[0] is 0; an empty section gets none.
    """
    first = np.searchsorted(sections, start, "right") - 1
    last = np.searchsorted(sections, end - 1, "right") - 1
    crossing = np.flatnonzero(first != last)
    owner = first if rule == "first" else last if rule == "last" else first.copy()
    if rule == "most":
        for t in crossing:
            cuts = np.concatenate([[start[t]], sections[first[t] + 1 : last[t] + 1], [end[t]]])
            owner[t] = first[t] + int(np.argmax(np.diff(cuts)))
    return np.bincount(owner, minlength=len(sections)), len(crossing)


def line_starts(text: str) -> np.ndarray:
    """First character of every line; a line feed belongs to the line that it ends."""
    out, at = [0], text.find("\n") + 1
    while 0 < at < len(text):
        out.append(at)
        at = text.find("\n", at) + 1
    return np.array(out, np.int64)


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "first", vocabulary: str | None = None) -> DataFrame:
    """A row per row of `docs`: doc_id, n_tokens, n_sections, n_crossing and section_tokens, an array with a count for each line.

    The counts of a text's lines sum to its tokens. A null or empty text has one empty line and no tokens. A null
    doc_id stays null; rows that repeat one are counted each by itself. An empty table gives no rows, and columns of
    whatever other names are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    vocabulary = vocabulary or default_vocabulary()
    names = ["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"]

    def run(batches):
        for whole in batches:
            for b in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                total, lines, crossing, each = [], [], [], []
                for x in b.column(1):
                    text = x.as_py() or ""
                    start, end = token_spans(text, vocabulary)
                    got, n = attributed(start, end, line_starts(text), rule)
                    total.append(len(start))
                    lines.append(len(got))
                    crossing.append(n)
                    each.append(got)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (total, lines, crossing)), pa.array(each, pa.list_(pa.int64()))], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>")
