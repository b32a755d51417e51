"""Phrase collocations by hierarchical naming of pairs.

Texts of one language become blocks: sequences of word numbers of the block's own, with breaks between pieces. A block
tells each distinct word once, with its count, dealt by a hash into buckets; a bucket sums what all blocks tell it, names
the frequent words, and answers each block with the names of its own words. Then two neighbouring names in a block make a
pair, pairs are told, summed and named in the same way, and their names replace the pairs' first places. So the names of
k words are pairs of names of k - 1 words that overlap, and what was no frequent phrase is a break.

What a block tells a bucket is one row, packed; the number of buckets grows with the input, and the most frequent pair
is told once a block like any other, so no bucket is larger than the rest.

A name's two parents are its first and its last k - 1 words: along them, counts of all beginnings and endings are handed
on, which gives the cuts, and a phrase lies inside a longer one with the same count just if it does in one that has it
as a parent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.scratch import Scratch
from weft.llm.words import LOWER, bytes_of, hashes, mix, slabs

#: Characters that end a piece; space and tab part words.
STOPS = b".,;:!?\x0a\x0b\x0c\x0d"
#: Bytes of text in a block (a longer text is a block of its own), and bytes of all texts for each bucket.
BLOCK, BUCKET = 4 << 20, 16 << 20

_STOP, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_STOP[list(STOPS)] = True
_BLANK[[0x20, 0x09]] = True
U = np.uint64

#: Of a block: its sequence (bucket -1) with its number of words, and what it tells each bucket.
_TOLD = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])
_TOLD_DDL = "block long, lang string, bucket int, n long, data binary"
#: Of a bucket: answers to blocks, and names.
_NAMED = pa.schema([("block", pa.int64()), ("data", pa.binary()), ("lang", pa.string()), ("id", pa.int64()), ("first", pa.int64()), ("rest", pa.int64()), ("word", pa.string()), ("a", pa.int64())])
_NAMED_DDL = "block long, data binary, lang string, id long, first long, rest long, word string, a long"


def _pack(columns: list[np.ndarray], tail: bytes = b"") -> bytes:
    """Columns of equal length, and bytes; one of small numbers or small steps takes little."""
    head = np.array([len(columns), len(columns[0])], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, *(np.diff(c, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns), tail]))


def _unpack(data: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    k, n = np.frombuffer(raw[:16], "<i8").tolist()
    steps = np.frombuffer(raw, np.uint8, 8 * k * n, 16).reshape(k, 8, n).transpose(0, 2, 1)
    return [np.cumsum(np.ascontiguousarray(x).view("<i8").ravel()) for x in steps], raw[16 + 8 * k * n :]


def _batch(block: int, lang: str, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """Rows (bucket, n, data) of a block."""
    buckets, n, data = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([lang] * len(rows)), pa.array(buckets, pa.int32()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], schema=_TOLD)


def _dealt(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of the runs of equal buckets."""
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    return [(int(bucket[lo]), lo, hi) for lo, hi in zip(cuts, [*cuts[1:], len(bucket)])]


def _blocks(buckets: int, size: int):
    """Blocks of (lang, text) rows: sequences of numbers of words, and the words."""

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for lang in whole.column(0).unique():
                for b in slabs(whole.filter(pa.compute.equal(whole.column(0), lang)), 1, size):
                    made = words(*bytes_of(b.column(1)))
                    if made is not None:
                        block += 1
                        yield _batch(block, lang.as_py(), told(*made))

    def words(data: np.ndarray, places: np.ndarray):
        """(dictionary, number of each word's in it, whether a word begins a piece); none without words."""
        data = LOWER[data]
        stop = _STOP[data]
        inside = ~(stop | _BLANK[data])
        edge = np.zeros(len(data) + 1, bool)
        edge[places] = True
        start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
        end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
        if not len(start):
            return None
        piece = np.cumsum(stop, dtype=np.int32)[start] + np.searchsorted(places, start, "right")
        offsets = np.concatenate([[0], np.cumsum(end - start)])
        return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode(), np.diff(piece, prepend=piece[0]) != 0

    def told(spelled: pa.DictionaryArray, broken: np.ndarray):
        known = spelled.dictionary
        places = np.frombuffer(known.buffers()[1], np.int64, len(known) + 1)
        letters = np.frombuffer(known.buffers()[2], np.uint8, places[-1])
        bucket = (mix(hashes(letters, places[:-1], places[1:]), 5) % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order))
        own = number[spelled.indices.to_numpy()]
        count = np.bincount(own, minlength=len(order))
        sequence = np.full(len(own) + int(broken.sum()), -1, np.int32)
        sequence[np.arange(len(own)) + np.cumsum(broken)] = own
        known = known.take(pa.array(order))
        rows = [(-1, len(own), _pack([sequence]))]
        # Words hold no line feed.
        return rows + [(k, hi - lo, _pack([np.arange(lo, hi), count[lo:hi]], b"\n".join(known.slice(lo, hi - lo).to_pylist()))) for k, lo, hi in _dealt(bucket[order])]

    return run


def _sums(key: np.ndarray, count: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a place of each key of at least that count, its count, and for each place the key's number, or -1)."""
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    total = np.zeros(len(first), np.int64)
    np.add.at(total, number, count)
    often = total >= least
    renumbered = np.where(often, np.cumsum(often) - 1, -1)
    return first[often], total[often], renumbered[number]


def _named(of_words: bool, least: int, buckets: int):
    """Names of what all blocks tell one bucket, unique within the language, and the answers to the blocks."""

    def run(key: tuple, told: pa.Table) -> pa.Table:
        lang, bucket = key[0].as_py(), key[1].as_py()
        parts = [_unpack(x) for x in told.column("data").to_pylist()]
        sizes = [len(c[0]) for c, _ in parts]
        columns = [np.concatenate(x) for x in zip(*(c for c, _ in parts))]
        number, count = columns[0], columns[1]
        if of_words:
            words = [w for _, tail in parts for w in tail.split(b"\n")]
            at, a, name = _sums(pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy(), count, least)
            about = [pa.nulls(len(at), pa.int64())] * 2 + [pa.array([words[i].decode() for i in at], pa.string())]
        else:
            first, rest = columns[2], columns[3]
            # A number for each pair, by the places of its two names among those that are here.
            seconds, second = np.unique(rest, return_inverse=True)
            at, a, name = _sums(np.unique(first, return_inverse=True)[1] * len(seconds) + second, count, least)
            about = [pa.array(first[at]), pa.array(rest[at]), pa.nulls(len(at), pa.string())]
        ids = name * buckets + bucket
        out, lo = [], 0
        for n, block in zip(sizes, told.column("block").to_pylist()):
            hit = np.flatnonzero(name[lo : lo + n] >= 0) + lo
            if len(hit):
                out.append((block, _pack([number[hit], ids[hit]])))
            lo += n
        k, m = len(out), len(at)
        lists = [
            pa.concat_arrays([pa.array([b for b, _ in out], pa.int64()), pa.nulls(m, pa.int64())]),
            pa.concat_arrays([pa.array([d for _, d in out], pa.binary()), pa.nulls(m, pa.binary())]),
            pa.array([lang] * (k + m), pa.string()),
            pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(np.arange(m) * buckets + bucket, pa.int64())]),
            *(pa.concat_arrays([pa.nulls(k, x.type), x]) for x in about),
            pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(a)]),
        ]
        return pa.Table.from_arrays(lists, schema=_NAMED)

    return run


def _pairs(last: bool, buckets: int):
    """What a block makes of the names that it is told: its pairs, and unless `last` the sequence of their numbers."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _TOLD.empty_table()
        sequence = _unpack(left.column("data")[0].as_py())[0][0]
        names = np.full(int(sequence.max(initial=-1)) + 2, -1, np.int64)
        for x in right.column("data").to_pylist():
            (number, ids), _ = _unpack(x)
            names[number] = ids
        named = names[sequence] >= 0  # a break, -1, reads the last, which is none
        both = named[:-1] & named[1:]
        if not both.any():
            return _TOLD.empty_table()
        base = np.int64(len(names))
        kinds, which, count = np.unique((sequence[:-1] * base + sequence[1:])[both], return_inverse=True, return_counts=True)
        first, rest = names[kinds // base], names[kinds % base]
        bucket = (mix(mix(first.view(U), 3) ^ rest.view(U), 7) % U(buckets)).astype(np.int64)
        order = np.lexsort((rest, first, bucket))
        first, rest, count, bucket = first[order], rest[order], count[order], bucket[order]
        rows = [(k, hi - lo, _pack([np.arange(lo, hi), count[lo:hi], first[lo:hi], rest[lo:hi]])) for k, lo, hi in _dealt(bucket)]
        if not last:
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            following = np.full(len(both), -1, np.int64)
            following[both] = number[which]
            rows.append((-1, 0, _pack([following[both | np.concatenate([[False], both[:-1]])]])))  # one break for a run of them
        return pa.Table.from_batches([_batch(left.column("block")[0].as_py(), left.column("lang")[0].as_py(), rows)])

    return run


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = 4) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases by number of words, and the words of each language.

    The first is a table for each k from 1 to `longest`: lang, id (unique in its language), first and rest (ids of its
    first and last k - 1 words), phrase, a (occurrences), heads and tails (occurrences of its first and of its last 1, 2,
    ... k words). The second: lang, n. Words are lower-cased in A-Z only. A null lang is `und`; a null text has no words.
    """
    tmp = Scratch(docs.sparkSession, "phrases")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    weight = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + weight // BUCKET
    blocks = tmp.keep(rows.mapInArrow(_blocks(buckets, BLOCK), _TOLD_DDL), "blocks-1")
    words = tmp.keep(blocks.where("bucket < 0").groupBy("lang").agg(F.sum("n").alias("n")), "words")
    out: list[DataFrame] = []
    for k in range(1, longest + 1):
        if k > 1:
            sequences = blocks.where("bucket < 0").select("block", "lang", "data")
            made = sequences.groupBy("block").cogroup(named.where("block is not null").select(F.col("block").alias("of"), "data").groupBy("of"))
            blocks = tmp.keep(made.applyInArrow(_pairs(k == longest, buckets), _TOLD_DDL), f"blocks-{k}")
            tmp.drop(f"blocks-{k - 1}")
        told = blocks.where("bucket >= 0").groupBy("lang", "bucket")
        named = tmp.keep(told.applyInArrow(_named(k == 1, least, buckets), _NAMED_DDL), f"named-{k}")
        own = named.where("id is not null").select("lang", "id", "first", "rest", "word", "a")
        if k == 1:
            out.append(own.select("lang", "id", "first", "rest", F.col("word").alias("phrase"), F.col("word").alias("final"), "a", F.array("a").alias("heads"), F.array("a").alias("tails")))
            continue
        head = out[-1].select("lang", F.col("id").alias("first"), "phrase", "heads")
        tail = out[-1].select("lang", F.col("id").alias("rest"), "final", "tails")
        known = own.join(head, ["lang", "first"]).join(tail, ["lang", "rest"])
        known = known.select("lang", "id", "first", "rest", F.concat_ws(" ", "phrase", "final").alias("phrase"), "final", "a", *(F.concat(x, F.array("a")).alias(x) for x in ("heads", "tails")))
        out.append(tmp.keep(known, f"phrases-{k}"))
    return out, words


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = 4, percent: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: for each language its `top` phrases of 2 to `longest` words.

    a, l, r: occurrences of the phrase, of what is before and of what is after its weakest cut; score: 2000000 a /
    (l + r), floored, the least of all cuts, ties to the earliest. A phrase that lies in a longer one with at least
    `percent` hundredths of its occurrences is left out, and so it is if that one is left out itself. Ranked by score,
    by a, then by phrase in byte order. n: all words of the language. Empty tables, texts without words and
    languages without frequent phrases give no rows; repeated rows count as often as they stand. No column but the
    two named is read.
    """
    levels, words = phrases(docs, text_col, lang_col, least, longest)
    exact = lambda x: F.col(x).cast("decimal(38,0)")
    found = None
    for k in range(2, longest + 1):
        # The least of (score, number of words before the cut, l, r).
        cuts = [
            F.struct(
                F.expr(f"2000000BD * cast(a as decimal(31,0)) div (cast(heads[{c - 1}] as decimal(31,0)) + cast(tails[{k - c - 1}] as decimal(31,0)))").alias("score"),
                F.lit(c).alias("cut"),
                F.col("heads")[c - 1].alias("l"),
                F.col("tails")[k - c - 1].alias("r"),
            )
            for c in range(1, k)
        ]
        own = levels[k - 1].withColumn("best", F.array_min(F.array(*cuts)))
        if k < longest:
            longer = levels[k].select("lang", F.explode(F.array("first", "rest")).alias("id"), F.col("a").alias("held")).groupBy("lang", "id").agg(F.max("held").alias("held"))
            own = own.join(longer, ["lang", "id"], "left").where(F.col("held").isNull() | (exact("held") * 100 < exact("a") * percent))
        own = own.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
        found = own if found is None else found.union(own)
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = found.withColumn("rank", order).where(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same in DuckDB, over `documents`, with the parameters' defaults.
SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w
  from documents),
totals as (select lang, sum(len(w))::bigint as n from pieces group by lang),
placed as (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from pieces, (values (1), (2), (3), (4)) as ks(k) where len(w) >= k),
f as (select lang, k, w[i:i + k - 1] as p, count(*)::bigint as a from placed group by all having count(*) >= 30),
cuts as (
  select x.lang, x.k, x.p, x.a, y.a as l, z.a as r, y.k as c, ((2000000::hugeint * x.a) // (y.a + z.a))::bigint as score
  from f x join f y on y.lang = x.lang and y.k < x.k and y.p = x.p[1:y.k]
           join f z on z.lang = x.lang and z.k = x.k - y.k and z.p = x.p[y.k + 1:]),
best as (select * from cuts qualify row_number() over (partition by lang, p order by score, c) = 1),
inner_of as (
  select distinct s.lang, s.p
  from (select lang, a, p, unnest([p[1:2], p[2:3], p[3:4], p[1:3], p[2:4]]) as q from f where k > 2) g
  join f s on s.lang = g.lang and s.p = g.q and s.k < len(g.p) and s.k > 1 and 100::hugeint * g.a >= 80::hugeint * s.a),
ranked as (
  select b.*, array_to_string(b.p, ' ') as phrase,
         row_number() over (partition by b.lang order by score desc, a desc, array_to_string(b.p, ' ')) as rank
  from best b anti join inner_of i on i.lang = b.lang and i.p = b.p)
select ranked.lang, rank::bigint as rank, phrase, a, l, r, n, score
from ranked join totals on totals.lang = ranked.lang where rank <= 2000
"""
