"""Best-fit packing planned on the length histogram by a configuration linear program.

A configuration is a multiset of lengths that fits one sequence; the program covers every length's count with as
few configurations as possible. Lengths are grouped upward to `UNITS` classes for it. It is solved by multiplicative
weights: each step prices a configuration by a knapsack dynamic program over the current dual weights - a length's
tokens, more for long ones, discounted by the share of its count that is covered already - and uses it a whole number of times; so the
solution is rounded as it is made, and the next step prices what is left. A use takes exact lengths of the classes, the
most plentiful ones, and closes with two that fill the sequence to the last token, or else leave the least room.

The shortest lengths of all, which the program doesn't see, and its last few pieces go through best fit on the exact
lengths, which closes what room is left. With a price for each length that is its tokens, the dual bound is the number
of full sequences that the tokens make. A plan above it is mended: the sequences with room, and ever more of
the full ones with the most pieces, are solved again as a whole, until the bound is met.

Only the histogram (at most `capacity` rows) and the plan come to the driver. The plan's rows grow with the number of
different lengths and configurations, not with the number of documents; places are dealt to the pieces by distributed
ranks.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.scratch import Scratch

CAPACITY = 4096
END_ID = 1
#: Words, and parts of words, that a worker remembers the ids of: about 20 MB of each.
REMEMBERED = 150_000
#: Classes of lengths in the program, steps of its solution, the rate at which what is covered loses its weight, and the
#: weight that a token of a piece as long as a sequence has above one of a short piece: long ones fit in fewer places.
UNITS, STEPS, RATE, BIAS = 512, 192, 0.1, 1.0
#: Share of the tokens, in the shortest pieces, that the program doesn't see: best fit closes gaps with them. It also
#: gets the share that the program leaves at its end, and a plan is mended by at most one sequence in so many.
SHORT, TAIL, MENDED = 0.02, 0.005, 2
#: Rows of a batch that a worker gives back at once.
ROWS = 4096


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Chunks that need no normalizing but ASCII-like lower-casing: printable ASCII and precomposed Latin letters.
_PLAIN = re.compile("[!-~\u00c0-\u012f\u0131-\u017f]+")
#: The vocabulary's own splitting pattern on such chunks in lower case.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+")


def _byte_letters() -> dict[int, str]:
    """Printable stand-ins of the 256 bytes, as byte-level vocabularies write them."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PartIds(dict):
    """Ids of one part of a word, by the vocabulary's model."""

    def __init__(self, model):
        self.model, self.letters = model, _byte_letters()

    def __missing__(self, part: str) -> bytes:
        shown = part.encode().decode("latin-1").translate(self.letters)
        ids = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(shown))
        if len(part) <= 64 and len(self) < REMEMBERED:  # the first that come are the frequent ones
            self[part] = ids
        return ids


class WordIds(dict):
    """Ids of a chunk between blanks, as little-endian 32-bit bytes; the tokenizer drops white space and never merges over it."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.parts = PartIds(self.tokenizer.model)

    def __missing__(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and "<|" not in word:
            parts = self.parts
            ids = b"".join([parts[p] for p in _PARTS.findall(word.lower())])
        else:  # other scripts, marks, rare white space, special tokens: the whole tokenizer
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= 64 and len(self) < REMEMBERED:
            self[word] = ids
        return ids


_words: dict[str, WordIds] = {}


def text_ids(text: str | None, vocabulary: str) -> bytes:
    """Ids of a whole text and the end id, as little-endian 32-bit bytes.

    The text is cut at spaces and line feeds only; any other white space goes to the tokenizer inside its word.
    """
    words = _words.get(vocabulary) or _words.setdefault(vocabulary, WordIds(vocabulary))
    parts = [words[w] for line in (text or "").split("\n") for w in line.split(" ") if w]
    parts.append(END_ID.to_bytes(4, "little"))
    return b"".join(parts)


def _cutter(vocabulary: str, capacity: int):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(b.column(0), b.column(1)):
                doc_id, ids = doc_id.as_py(), memoryview(text_ids(text.as_py(), vocabulary))
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own))):
                        column.append(value)
                if len(out[0]) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=names)
                    out = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=names)

    return run


def priced(lengths: np.ndarray, counts: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """The bounded knapsack: how many of each length make the full configuration of greatest worth."""
    best = np.full(capacity + 1, -np.inf)  # of exactly so many tokens
    best[0] = 0
    taken = []
    for i, n in enumerate(lengths):
        k = 1
        room = min(int(counts[i]), capacity // int(n))
        while room > 0:  # 1, 2, 4, ... copies at once
            q = min(k, room)
            w = q * int(n)
            other = best[: capacity + 1 - w] + q * worth[i]
            better = other > best[w:]
            best[w:][better] = other[better]
            taken.append((i, q, w, np.packbits(better)))
            room -= q
            k *= 2
    out = np.zeros(len(lengths), np.int64)
    c = capacity if np.isfinite(best[capacity]) else int(np.argmax(best))  # no room left over where that can be
    for i, q, w, better in reversed(taken):
        at = c - w
        if at >= 0 and better[at >> 3] >> (7 - (at & 7)) & 1:
            out[i] += q
            c -= w
    return out


def closing(left: np.ndarray, room: int, low: int, high: int) -> tuple[int, int] | None:
    """Two lengths that are left, one of them between low and high, that fill a room, or else leave least; the most plentiful."""
    for gap in range(room):
        a = np.arange(max(1, low), min(high, room - gap - 1) + 1)
        if not len(a):
            return None
        b = room - gap - a
        both = np.where(a == b, left[a] // 2, np.minimum(left[a], left[b]))
        i = int(both.argmax())
        if both[i] > 0:
            return int(a[i]), int(b[i])
    return None


def realized(classes: list[int], often: int, left: np.ndarray, unit: int, capacity: int) -> list[tuple[Counter, int]]:
    """Sequences of exact lengths for so many uses of a configuration, its largest class first; what they take is taken from `left`.

    Uses of the same lengths are one; they end early where a class has run out, since closing takes lengths of any class.
    """
    out: list[tuple[Counter, int]] = []
    while often:
        taken: Counter = Counter()
        for c in classes[:-2] if len(classes) > 1 else classes:
            low = (c - 1) * unit + 1
            there = left[low : min(c * unit, capacity) + 1]
            i = int(there.argmax())
            if not there[i]:
                break
            taken[low + i] += 1
            there[i] -= 1
        found = sum(taken.values()) == (len(classes) - 2 if len(classes) > 1 else 1)
        if found and len(classes) > 1:
            room = capacity - sum(n * k for n, k in taken.items())
            # What the classes were rounded up by, in further pieces of the smallest.
            low = (classes[-1] - 1) * unit + 1
            n = low + int(left[low : classes[-1] * unit + 1].argmax())
            k = min(int(left[n]), max(0, room - (classes[-2] + classes[-1]) * unit) // n)
            if k > 0:
                taken[n] += k
                left[n] -= k
                room -= n * k
            last = closing(left, room, (classes[-2] - 1) * unit + 1, classes[-2] * unit)
            found = last is not None
        for n, k in taken.items():
            left[n] += k
        if not found:
            break
        if len(classes) > 1:
            taken.update(last)
        q = min(often, *(int(left[n]) // k for n, k in taken.items()))
        for n, k in taken.items():
            left[n] -= q * k
        out.append((taken, q))
        often -= q
    return out


def placed(histogram: dict[int, int], capacity: int, steps: int = STEPS) -> list[tuple[Counter, int]]:
    """Sequences by the program, in exact lengths.

    Weights start in proportion to the tokens of a class, rising for long pieces, and fall with the share of the class
    that is covered. Steps are equal shares of the tokens, of one use at least; they end when the
    share `TAIL` of the tokens is left.
    """
    unit = -(-capacity // UNITS)
    lengths = np.arange(capacity + 1)
    left = np.zeros(capacity + 1, np.int64)
    left[list(histogram)] = list(histogram.values())
    tokens = int((lengths * left).sum())
    left[np.cumsum(lengths * left) <= SHORT * tokens] = 0
    classes = -(-lengths // unit)
    count = lambda: np.bincount(classes, left, UNITS + 1).astype(np.int64)
    whole = count()
    step = max(1, tokens // (capacity * steps))
    out: list[tuple[Counter, int]] = []
    while (lengths * left).sum() > TAIL * tokens:
        counts = count()
        some = np.flatnonzero(counts)
        done = 1 - counts[some] / whole[some]
        config = priced(some, counts[some], some * (1 + BIAS * some / (capacity // unit)) * np.exp(-RATE * (done - done.min())), capacity // unit)
        inside = np.flatnonzero(config)[::-1]
        often = min(step, int((counts[some[inside]] // config[inside]).min()))
        made = realized(np.repeat(some[inside], config[inside]).tolist(), often, left, unit, capacity)
        if not made:
            break
        out += made
    return out


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int, begun: list[tuple[Counter, int]] = ()) -> list[tuple[Counter, int]]:
    """Best-fit decreasing on a histogram, into sequences already begun as well: (contents, number of such sequences)."""
    room: dict[int, dict[tuple, int]] = {}
    order: list[int] = []

    def add(left: int, contents: tuple, n: int) -> None:
        if left not in room:
            room[left] = {}
            bisect.insort(order, left)
        room[left][contents] = room[left].get(contents, 0) + n

    for contents, n in begun:
        add(capacity - sum(size * k for size, k in contents.items()), tuple(sorted(contents.items(), reverse=True)), n)
    for i in np.argsort(-lengths, kind="stable"):
        size, k = int(lengths[i]), int(counts[i])
        while k:
            at = bisect.bisect_left(order, size)
            if at == len(order):
                each = capacity // size
                full, rest = divmod(k, each)
                if full:
                    add(capacity - each * size, ((size, each),), full)
                if rest:
                    add(capacity - rest * size, ((size, rest),), 1)
                k = 0
                continue
            left = order[at]
            contents, n = next(iter(room[left].items()))
            each = min(left // size, k)
            q = min(n, k // each)
            if q == n:
                del room[left][contents]
                if not room[left]:
                    del room[left]
                    order.pop(at)
            else:
                room[left][contents] = n - q
            add(left - each * size, (*contents, (size, each)), q)
            k -= q * each
    out = []
    for inside in room.values():
        for contents, n in inside.items():
            whole: Counter = Counter()
            for size, each in contents:
                whole[size] += each
            out.append((whole, n))
    return out


def mended(made: list[tuple[Counter, int]], bound: int, capacity: int) -> tuple[list[tuple[Counter, int]], int]:
    """(a plan of the same pieces in fewer sequences, if one is found, pieces in sequences that were solved again)."""
    room = lambda x: capacity - sum(n * k for n, k in x[0].items())
    every = sum(n for _, n in made)
    order = sorted(made, key=lambda x: (room(x) == 0, -sum(x[0].values())))
    some = sum(n for c, n in made if room((c, n)))
    best, again = made, 0
    while every > bound and some <= every // MENDED + 64:
        at = taken = 0
        pieces: Counter = Counter()
        while at < len(order) and taken < some:
            contents, n = order[at]
            for size, k in contents.items():
                pieces[size] += n * k
            taken += n
            at += 1
        lengths = np.array(sorted(pieces), np.int64)
        solved = order[at:] + best_fit(lengths, np.array([pieces[int(x)] for x in lengths]), capacity)
        if sum(n for _, n in solved) < every:
            every, best, again = sum(n for _, n in solved), solved, sum(pieces.values())
        some *= 2
    return best, again


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[Counter, int]], float]:
    """(contents, number of such sequences) that hold the whole histogram, and the share of pieces that the program placed."""
    begun = placed(histogram, capacity)
    left = np.zeros(capacity + 1, np.int64)
    left[list(histogram)] = list(histogram.values())
    for contents, n in begun:
        for size, k in contents.items():
            left[size] -= n * k
    total = sum(histogram.values())
    lengths = np.flatnonzero(left)
    bound = -(-sum(n * k for n, k in histogram.items()) // capacity)
    out, again = mended(best_fit(lengths, left[lengths], capacity, begun), bound, capacity)
    return out, 1 - (int(left.sum()) + again) / total if total else 1.0


def _places(made: list[tuple[Counter, int]]) -> tuple[np.ndarray, ...]:
    """For each length and configuration: the ranks that go there, how many to a sequence, first sequence and offset."""
    rows, taken, first = [], Counter(), 0
    for contents, n in made:
        at = 0
        for size in sorted(contents, reverse=True):
            each = contents[size]
            rows.append((size, taken[size], each, first, at))
            taken[size] += n * each
            at += each * size
        first += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return tuple(table[:, i] for i in range(5))


def _dealer(places: tuple[np.ndarray, ...]):
    size, low, each, first, at = places
    starts = {int(n): (int(np.searchsorted(size, n)), int(np.searchsorted(size, n, "right"))) for n in np.unique(size)}

    def run(batches):
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(x)).to_numpy() for x in ("length", "rank"))
            row = np.empty(len(length), np.int64)
            for n in np.unique(length):
                lo, hi = starts[int(n)]
                own = np.flatnonzero(length == n)
                row[own] = lo + np.searchsorted(low[lo:hi], rank[own], "right") - 1
            local = rank - low[row]
            keep = [i for i, f in enumerate(b.schema) if f.name != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in keep), pa.array(first[row] + local // each[row]), pa.array(at[row] + local % each[row] * length)],
                names=[*(b.schema.field(i).name for i in keep), "sequence_id", "offset"],
            )

    return run


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and the end id (a null text: the end id alone); longer ones than `capacity` are cut
    into pieces of that length, the last of which may be shorter. Rows with a null or a repeated doc_id are packed
    like any other. Equal pieces of equal documents are interchangeable.
    """
    tmp = Scratch(docs.sparkSession, "pack")
    vocabulary = vocabulary or default_vocabulary()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = tmp.keep(rows.mapInArrow(_cutter(vocabulary, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    places = _places(plan(histogram, capacity)[0])

    buckets = min(max(sum(histogram.values()) // 20_000, 64), 1 << 16)
    at = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sums = at.groupBy("length", "_bucket").count()
    offset = F.sum("count").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("count")
    sums = sums.select(F.col("length").alias("l"), F.col("_bucket").alias("b"), offset.alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = at.withColumn("_n", F.row_number().over(within)).join(sums, (F.col("length") == F.col("l")) & (F.col("_bucket") == F.col("b")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_n") - 1).cast("long").alias("rank"))
    return ranked.mapInArrow(_dealer(places), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
