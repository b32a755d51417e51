"""Removal of passages that an earlier document already has, by repeated-phrase automata.

Every run of `window` words holds an anchor: its phrase of `PHRASE` words of least hash. Equal runs have equal
anchors, wherever they stand, so a run can only recur where its anchor does. Phrases that are anchors in two or
more documents are confirmed by a count over all documents, and so are the runs round them: a run that recurs has
the smallest doc_id that holds it as its owner. The owner's recurring passages are what the automata are made of.

An automaton's shard holds the passages round phrases that were first seen in the same documents; a shard whose
passages would outgrow a task is cut into several automata. Every stretch of any document that has a confirmed
phrase streams through the automata of that phrase's shard, in blocks, and the words of each place where a run of a
passage of a smaller doc_id is located go. The automata compare the words themselves - each different word is one
symbol - so what is removed never rests on a hash.

Counts are combined before they are shuffled. A passage that a third of all documents share is one passage in one
automaton, through which their stretches stream in as many tasks as they fill.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.scratch import Scratch
from weft.llm.words import U, bytes_of, grams, joined, mix, signed, slabs, sliding_least, words_of

#: Words of an anchor phrase.
PHRASE = 6
#: Bytes of the passages of one automaton, bytes of text that one task streams through it, and occurrences of phrases in a shard.
AUTOMATON, STREAM, SHARD = 1 << 19, 1 << 22, 10_000
#: Runs in one stretch; a longer one goes on in the next.
STRETCH = 2048


class Slab:
    """Words, phrases and anchors of a few documents."""

    def __init__(self, batch: pa.RecordBatch, text: int, window: int):
        self.data, places = bytes_of(batch.column(text))
        self.words, self.start, self.end, self.first = words_of(self.data, places)
        self.window, n = window, len(self.words)
        self.phrase = min(PHRASE, window)
        self.doc = np.repeat(np.arange(batch.num_rows), np.diff(self.first))
        self.phrases = grams(self.words, self.phrase)
        #: Places where a run of `window` words of one document starts, and the hash of its anchor.
        self.runs = np.zeros(0, np.int64)
        if n >= window:
            self.runs = np.flatnonzero(self.doc[: n - window + 1] == self.doc[window - 1 :])
            self.anchors = sliding_least(self.phrases, window - self.phrase + 1)[self.runs]
        else:
            self.anchors = np.zeros(0, np.uint64)
        #: A run is covered by its phrases at these places.
        self.offsets = [*range(0, window - self.phrase, self.phrase), window - self.phrase]

    def digest(self, runs: np.ndarray, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each of the runs that start at these places."""
        return joined(self.phrases if not seed else grams(self.words, self.phrase, seed), runs, self.offsets)


def _anchor_rows(window: int):
    """(document, anchor) of all runs; neighbouring runs with one anchor give a row."""

    def run(batches):
        for whole in batches:
            for batch in slabs(whole, 1):
                s = Slab(batch, 1, window)
                doc = s.doc[s.runs]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (s.anchors[1:] != s.anchors[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[new])), signed(s.anchors[new])], names=["doc_id", "phrase"])

    return run


def _list_of(column: pa.Array, i: int, *fields: str) -> list[np.ndarray]:
    """The fields of the structs in row i of a list column; empty for a null list."""
    x = column[i].values if column[i].is_valid else None
    return [np.zeros(0, np.int64) if x is None else x.field(f).to_numpy(zero_copy_only=False) for f in fields]


def _confirmed_runs(s: Slab, phrases: pa.Array, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of a slab whose anchors are confirmed, as indices of s.runs, and the shard of each."""
    bounds = np.searchsorted(s.runs, s.first)
    at, shard = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(s.first) - 1):
        phrase, lo = _list_of(phrases, i, "phrase", "lo")
        if len(phrase):
            order = np.argsort(phrase.view(np.uint64))
            known = phrase.view(np.uint64)[order]
            own = s.anchors[bounds[i] : bounds[i + 1]]
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = np.flatnonzero(known[place] == own)
            at.append(hit + bounds[i])
            shard.append((mix(lo[order][place[hit]].astype(np.uint64), 5) % U(max(1, shards))).astype(np.int64))
    return np.concatenate(at), np.concatenate(shard)


def _candidate_rows(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())])

    def run(batches):
        for whole in batches:
            for batch in slabs(whole, 1):
                s = Slab(batch, 1, window)
                runs = s.runs[_confirmed_runs(s, batch.column(2), 1)[0]]
                if len(runs):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(s.doc[runs])), signed(s.digest(runs)), signed(s.digest(runs, 1))], schema=schema)

    return run


def _stretches(window: int, shards: int):
    """Passages (the recurring runs that a document owns) and stretches (its other runs round confirmed phrases), by shard."""
    schema = pa.schema([("shard", pa.int64()), ("passage", pa.bool_()), ("doc_id", pa.int64()), ("h", pa.int64()), ("at", pa.int64()), ("words", pa.binary())])

    def run(batches):
        for whole in batches:
            for batch in slabs(whole, 1):
                s = Slab(batch, 1, window)
                at, shard = _confirmed_runs(s, batch.column(2), shards)
                runs = s.runs[at]
                d1 = s.digest(runs) if len(runs) else np.zeros(0, np.uint64)
                doc, own = s.doc[runs], np.zeros(len(runs), bool)
                bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                for i in range(batch.num_rows):
                    if batch.column(3)[i].is_valid and bounds[i] < bounds[i + 1]:
                        have = batch.column(3)[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                        own[bounds[i] : bounds[i + 1]] = np.isin(d1[bounds[i] : bounds[i + 1]], have)
                if not len(runs):
                    continue
                # Neighbouring runs of one document, shard and side are one stretch.
                new = np.ones(len(runs), bool)
                new[1:] = (runs[1:] != runs[:-1] + 1) | (doc[1:] != doc[:-1]) | (shard[1:] != shard[:-1]) | (own[1:] != own[:-1])
                first = np.flatnonzero(new)
                first = np.concatenate([np.arange(a, b, STRETCH) for a, b in zip(first, [*first[1:], len(runs)])])
                last = np.concatenate([first[1:], [len(runs)]]) - 1
                data = s.data.tobytes()
                words = [data[a:b] for a, b in zip(s.start[runs[first]].tolist(), s.end[runs[last] + window - 1].tolist())]
                own_doc = pa.array(doc[first])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[first]), pa.array(own[first]), batch.column(0).take(own_doc), batch.column(4).take(own_doc), pa.array(runs[first] - s.first[doc[first]]), pa.array(words, pa.binary())],
                    schema=schema,
                )

    return run


def located(passages: list[tuple[int, bytes]], stretches: list[bytes], window: int) -> list[list[tuple[int, int]]]:
    """For each stretch the (word place, owner) of every run of `window` words that one of the (owner, words) passages has.

    Each different word is a symbol; an automaton of all the passages' runs locates them in the stretches' symbols.
    """
    symbols: dict[bytes, str] = {}
    automaton = ahocorasick.Automaton()
    owners: dict[str, int] = {}
    for owner, words in passages:
        text = "".join([symbols.setdefault(w, chr(len(symbols) + 1 + 2048 * (len(symbols) >= 0xD7FF))) for w in words.split()])
        for i in range(len(text) - window + 1):
            run = text[i : i + window]
            if owners.get(run, owner) >= owner:
                owners[run] = owner
    for run, owner in owners.items():
        automaton.add_word(run, owner)
    if not owners:
        return [[] for _ in stretches]
    automaton.make_automaton()
    out, known = [], {}
    for words in stretches:
        if words not in known:  # copies stream once
            text = "".join([symbols.get(w, "\0") for w in words.split()])
            known[words] = [(end - window + 1, owner) for end, owner in automaton.iter(text)]
        out.append(known[words])
    return out


def _locator(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, h, at = (right.column(x).to_numpy() for x in ("doc_id", "h", "at"))
        rows: list[tuple[int, int, int, int]] = []
        if left.num_rows and right.num_rows:
            found = located(list(zip(left.column("doc_id").to_pylist(), left.column("words").to_pylist())), right.column("words").to_pylist(), window)
            for i, hits in enumerate(found):
                begin = end = -1
                for place, owner in hits:
                    if owner < doc[i]:
                        if place > end:
                            if end >= 0:
                                rows.append((doc[i], h[i], begin + at[i], end + at[i]))
                            begin = place
                        end = place + window
                if end >= 0:
                    rows.append((doc[i], h[i], begin + at[i], end + at[i]))
        return pa.table([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], schema=schema)

    return run


def _remover(window: int):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]

    def run(batches):
        for whole in batches:
            for batch in slabs(whole, 1):
                data, places = bytes_of(batch.column(1))
                _, start, end, first = words_of(data, places, hashed=False)
                n, removed, digest = [], [], []
                for i in range(batch.num_rows):
                    a, b = first[i], first[i + 1]
                    text = data[start[a] : end[b - 1]].tobytes().split() if b > a else []
                    lo, hi = _list_of(batch.column(2), i, "lo", "hi")
                    if len(lo):
                        gone = np.zeros(b - a + 1, np.int64)
                        np.add.at(gone, lo, 1)
                        np.add.at(gone, hi, -1)
                        text = [text[k] for k in np.flatnonzero(np.cumsum(gone)[:-1] == 0)]
                    n.append(b - a)
                    removed.append(b - a - len(text))
                    digest.append(hashlib.sha256(b" ".join(text)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], names=names)

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """A row per row of `docs`: doc_id, n_words, n_removed, kept_sha256 (of the kept words between single spaces).

    Removed are the words covered by a run of `window` words that also starts in a document with a smaller doc_id;
    runs are judged on the input. A null text has no words. Texts of fewer words keep them all. Rows with equal
    doc_ids count as one document; a row with a null doc_id neither loses words nor takes any from others. An empty
    table gives no rows, and other columns, whatever their names, are not read.
    """
    tmp = Scratch(docs.sparkSession, "substring")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = rows.where("doc_id is not null")
    anchors = known.mapInArrow(_anchor_rows(window), "doc_id long, phrase long")
    confirmed = tmp.keep(anchors.groupBy("phrase").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("phrase", "lo"), "confirmed")
    lists = tmp.keep(anchors.join(confirmed, "phrase").groupBy("doc_id").agg(F.collect_set(F.struct("phrase", "lo")).alias("phrases")), "lists")
    # Which runs recur, and who has them first: the passages.
    candidates = known.join(lists, "doc_id").select("doc_id", "text", "phrases").mapInArrow(_candidate_rows(window), "doc_id long, d1 long, d2 long")
    owners = candidates.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("hi")).where("doc_id < hi")
    owned = tmp.keep(owners.groupBy("doc_id").agg(F.collect_list("d1").alias("owned")), "owned")
    # Automata of the passages, and the stretches that stream through them.
    shards = 1 + (lists.agg(F.sum(F.size("phrases"))).first()[0] or 0) // SHARD
    both = known.join(lists, "doc_id").join(owned, "doc_id", "left").select("doc_id", "text", "phrases", "owned", F.xxhash64("text").alias("h"))
    parts = tmp.keep(both.mapInArrow(_stretches(window, shards), "shard long, passage boolean, doc_id long, h long, at long, words binary"), "stretches")
    size = F.octet_length("words")
    deal = parts.groupBy("shard").agg(F.sum(F.when(F.col("passage"), size)).alias("l"), F.sum(F.when(~F.col("passage"), size)).alias("r")).where("l > 0 and r > 0")
    deal = deal.select("shard", F.ceil(F.col("l") / AUTOMATON).cast("int").alias("automata"), F.ceil(F.col("r") / STREAM).cast("int").alias("blocks"))
    parts = parts.join(tmp.keep(deal, "deal"), "shard")
    place = F.xxhash64("doc_id", "at")
    left = parts.where("passage").withColumn("automaton", F.pmod(place, "automata")).withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1L)")))
    right = parts.where("not passage").withColumn("block", F.pmod(place, "blocks")).withColumn("automaton", F.explode(F.expr("sequence(0L, automata - 1L)")))
    keys = ["shard", "automaton", "block"]
    again = lambda df, *columns: df.select(*(F.col(c).alias(c) for c in (*keys, *columns)))  # noqa: E731  (both sides are of one table)
    left, right = again(left, "doc_id", "words"), again(right, "doc_id", "h", "at", "words")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_locator(window), "doc_id long, h long, lo long, hi long")
    gone = tmp.keep(found.groupBy("doc_id", "h").agg(F.collect_set(F.struct("lo", "hi")).alias("gone")), "gone")
    return rows.withColumn("h", F.xxhash64("text")).join(gone, ["doc_id", "h"], "left").select("doc_id", "text", "gone").mapInArrow(_remover(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
