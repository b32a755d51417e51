"""Byte-pair vocabularies: pair counts of all chunks from Spark, the choice of merges on the driver, encoding of chunks on the executors."""

from __future__ import annotations

import heapq
import itertools
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.literals import SPECIAL_TOKENS
from weft.functions.text import pretokens
from weft.sources.shared import shared_folder, slices

Merges = list[tuple[int, int]]
#: Chunks that a worker remembers the ids of.
REMEMBERED = 200_000
#: Pairs that a round of training brings to the driver; those after them are bounded by the last.
ROUND_PAIRS = 2048
#: Merges after which the chunk table is written anew.
WRITTEN = 16
#: The chunk table: a row for each block of chunks, their ids (32 bits) each ended by -1, and their counts (64 bits).
STATE = "ids binary, n binary"


def chunk_counts(docs: DataFrame, text: str, pattern: str = "isolating") -> DataFrame:
    return docs.select(F.explode(pretokens(F.col(text), pattern)).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("n"))


def train(counted: Iterable[tuple[str, int]], size: int, start: Merges | None = None) -> Merges:
    """Merge rules up to `size` tokens: the most frequent pair each time, on a tie the pair of least ids.

    `start` is inherited, in order, before anything is counted. Token 256 + i is what rule i makes.
    """
    words = [(list(c.encode()), n) for c, n in counted]
    merges: Merges = []
    pairs: Counter = Counter()
    holders: defaultdict[tuple[int, int], set[int]] = defaultdict(set)
    for k, (ids, n) in enumerate(words):
        for p in zip(ids, ids[1:]):
            pairs[p] += n
            holders[p].add(k)
    heap = [(-n, p) for p, n in pairs.items()]
    heapq.heapify(heap)

    def apply(pair: tuple[int, int]) -> None:
        new = 256 + len(merges)
        merges.append(pair)
        touched = set()
        for k in holders.pop(pair, ()):
            ids, n = words[k]
            for p in zip(ids, ids[1:]):
                pairs[p] -= n
                touched.add(p)
            at, out = 0, []
            while at < len(ids):
                if at + 1 < len(ids) and (ids[at], ids[at + 1]) == pair:
                    out.append(new)
                    at += 2
                else:
                    out.append(ids[at])
                    at += 1
            words[k] = (out, n)
            for p in zip(out, out[1:]):
                pairs[p] += n
                holders[p].add(k)
                touched.add(p)
        for p in touched:
            if pairs[p] > 0:
                heapq.heappush(heap, (-pairs[p], p))

    for pair in start or ():
        apply(pair)
    while 256 + len(merges) < size and heap:
        n, pair = heapq.heappop(heap)
        if -n == pairs[pair] and -n > 0 and pair in holders:
            apply(pair)
    return merges


def _flat(ids: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a block's chunks in a row, each chunk ended by -1, and at each id the count of its chunk."""
    out = np.frombuffer(ids, "<i4").astype(np.int64)
    return out, np.repeat(np.frombuffer(n, "<i8"), np.diff(np.flatnonzero(out < 0), prepend=-1))


def _block(ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A row of the chunk table: a block of chunks, without those of one id, which hold no pair."""
    ends = np.flatnonzero(ids < 0)
    sizes = np.diff(ends, prepend=-1)
    keep = np.repeat(sizes > 2, sizes)
    flat = [ids[keep].astype("<i4").tobytes(), n[ends][sizes > 2].astype("<i8").tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in flat], names=["ids", "n"])


def _apply(ids: np.ndarray, n: np.ndarray, merges: Merges, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids after `merges` in order; the first of them makes token `first`."""
    for new, (a, b) in enumerate(merges, first):
        at = np.flatnonzero((ids[:-1] == a) & (ids[1:] == b))
        if a == b and len(at):  # in a run of one id, every other place from the left
            starts = np.diff(at, prepend=-2) != 1
            at = at[(at - at[starts][np.cumsum(starts) - 1]) % 2 == 0]
        if len(at):
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids[at] = new
            ids, n = ids[keep], n[keep]
    return ids, n


def _rewritten(state: DataFrame, merges: Merges, first: int) -> DataFrame:
    """The chunk table after `merges`."""

    def run(batches):
        for b in batches:
            for ids, n in zip(b.column(0), b.column(1)):  # a block at a time
                yield _block(*_apply(*_flat(ids.as_py(), n.as_py()), merges, first))

    return state.mapInArrow(run, STATE)


def _pair_counts(state: DataFrame, merges: Merges, first: int) -> DataFrame:
    """(a, b, n) of every pair in the chunk table after `merges`."""

    def run(batches):
        seen = []
        for batch in batches:
            for block, counts in zip(batch.column(0), batch.column(1)):  # one at a time
                ids, n = _apply(*_flat(block.as_py(), counts.as_py()), merges, first)
                ok = (ids[:-1] >= 0) & (ids[1:] >= 0)
                pairs = pa.table({"p": (ids[:-1] << 32 | ids[1:])[ok], "n": n[:-1][ok]})
                seen.append(pairs.group_by("p", use_threads=False).aggregate([("n", "sum")]))
        if seen:
            every = pa.concat_tables(seen).group_by("p", use_threads=False).aggregate([("n_sum", "sum")])
            p = every["p"].to_numpy()
            columns = [pa.array(p >> 32, pa.int32()), pa.array(p & 0xFFFFFFFF, pa.int32()), every["n_sum_sum"].combine_chunks()]
            yield from pa.table(columns, names=["a", "b", "n"]).to_batches()

    return state.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _settled(top: list[tuple[int, int, int]], complete: bool, most: int) -> Merges:
    """The next merges, at most `most`, that exact counts (a, b, n), the highest first, leave no doubt about.

    A merge lowers the counts only of pairs that start with its second or end with its first id. The pairs with what it
    makes are at most as frequent as those they came from. The first pair that any of these might precede ends the round.
    """
    least = 0 if complete else top[-1][2]
    best_left: dict[int, int] = {}
    best_right: dict[int, int] = {}
    for a, b, n in top:
        best_left.setdefault(b, n)
        best_right.setdefault(a, n)
    out: Merges = []
    firsts: set[int] = set()
    seconds: set[int] = set()
    before = behind = 0
    for a, b, n in top:
        if len(out) == most or a in seconds or b in firsts or before >= n or behind > n:
            break
        out.append((a, b))
        firsts.add(a)
        seconds.add(b)
        before = max(before, min(n, max(best_left.get(a, 0), least)))
        behind = max(behind, min(n, max(best_right.get(b, 0), least)))
    return out


def trained(counted: DataFrame, size: int, start: Merges | None = None) -> Merges:
    """What `train` makes of (chunk, n), with the chunks left on the executors: a round counts the pairs of all of them."""
    spark = counted.sparkSession
    folder = f"{shared_folder(spark)}/weft-bpe-{uuid.uuid4().hex[:12]}"
    merges: Merges = list(start or ())

    def spelled(batches):
        encoder = Encoder(merges)
        for b in slices(batches, 0):
            ids = [[*(encoder[c] if merges else c.encode()), -1] for c in b.column(0).to_pylist()]
            yield _block(np.fromiter(itertools.chain.from_iterable(ids), np.int64), np.repeat(b.column(1).to_numpy(), [len(x) for x in ids]))

    def remove(path: str) -> None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def written(df: DataFrame, name: int) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(STATE).parquet(f"{folder}/{name}")

    try:
        at = len(merges)
        state = written(counted.select("chunk", "n").mapInArrow(spelled, STATE), at)
        while 256 + len(merges) < size:
            if len(merges) - at >= WRITTEN:
                state = written(_rewritten(state, merges[at:], 256 + at), len(merges))
                remove(f"{folder}/{at}")
                at = len(merges)
            counts = _pair_counts(state, merges[at:], 256 + at).orderBy(F.desc("n"), "a", "b").limit(ROUND_PAIRS)
            top = [(r["a"], r["b"], r["n"]) for r in counts.collect()]
            if not top:
                break
            merges += _settled(top, len(top) < ROUND_PAIRS, size - 256 - len(merges))
    finally:
        remove(folder)
    return merges


def fitted(docs: DataFrame, text: str, size: int, pattern: str = "isolating") -> Merges:
    """Train on all chunks of a corpus."""
    return trained(chunk_counts(docs, text, pattern), size)


def superwords(docs: DataFrame, text: str, size: int, stage1: int, pattern: str = "baseline") -> Merges:
    """Two stages: rules inside words up to `stage1` tokens, then, inheriting those, rules across them."""
    check_superwords(size, stage1, pattern)
    first = fitted(docs, text, stage1, pattern)
    out = trained(chunk_counts(docs, text, "stage2"), size, first)
    if out[: len(first)] != first:
        raise ValueError("the second stage has not inherited the rules of the first")
    return out


def check_superwords(size: int, stage1: int, pattern: str = "baseline") -> None:
    """Two stages need the baseline pattern, and a first one between the bytes and the whole size (without the specials)."""
    if pattern != "baseline":
        raise ValueError("superwords need the baseline pattern")
    if not 256 <= stage1 <= size:
        raise ValueError("stage1 must lie between 256 and the vocabulary size")


def token_bytes(merges: Merges) -> list[bytes]:
    out = [bytes([i]) for i in range(256)]
    for a, b in merges:
        out.append(out[a] + out[b])
    return out


def recovered(ranks: dict[bytes, int]) -> Merges:
    """Merge rules, in this module's numbers, of a vocabulary that gives ranks only: each token's two parts are what the
    rules before it make of its bytes.

    All 256 bytes must have a rank, which is their seed; a token that earlier rules don't bring down to two parts is an error.
    """
    if any(bytes([i]) not in ranks for i in range(256)):
        raise ValueError("every byte needs a rank")
    out: Merges = []
    encoder = Encoder(out)
    for token in sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__):
        parts = encoder.merged(list(token))
        if len(parts) != 2:
            raise ValueError(f"{token!r} has {len(parts)} parts")
        pair = (parts[0], parts[1])
        encoder.rank[pair] = len(out)
        out.append(pair)
    return out


def finalized(merges: Merges, survivors: set[int], target: int) -> list[bytes]:
    """The bytes and, by rank, survivors that two kept tokens make, until there are exactly `target`; then specials follow."""
    tokens = token_bytes(merges)
    kept = dict.fromkeys(tokens[:256])
    for i in range(256, len(tokens)):
        t = tokens[i]
        if len(kept) < target and i in survivors and any(t[:k] in kept and t[k:] in kept for k in range(1, len(t))):
            kept[t] = None
    if len(kept) != target:
        raise ValueError(f"{len(kept)} tokens can be kept; {target} are wanted")
    return [*kept, *(s.encode() for s in SPECIAL_TOKENS)]


class Encoder(dict):
    """Ids of a chunk by the merge rules; remembers chunks."""

    def __init__(self, merges: Merges):
        self.rank = {p: i for i, p in enumerate(merges)}

    def merged(self, ids: list[int]) -> list[int]:
        """Ids of bytes, or of what some rules made of them, after all rules."""
        rank = self.rank
        while len(ids) > 1:
            best = min(zip(ids, ids[1:]), key=lambda p: rank.get(p, 1 << 60))
            if best not in rank:
                break
            new, out, at = 256 + rank[best], [], 0
            while at < len(ids):
                if at + 1 < len(ids) and (ids[at], ids[at + 1]) == best:
                    out.append(new)
                    at += 2
                else:
                    out.append(ids[at])
                    at += 1
            ids = out
        return ids

    def __missing__(self, chunk: str) -> list[int]:
        ids = self.merged(list(chunk.encode()))
        if len(chunk) <= 64:
            if len(self) > REMEMBERED:
                self.clear()
            self[chunk] = ids
        return ids


    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The rules' pairs, each in 64 bits, sorted, with their ranks."""
        keys = np.array([a << 32 | b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        return keys[order], np.fromiter(self.rank.values(), np.int64, len(keys))[order]

    def all(self, chunks: list[str]) -> list[list[int]]:
        """Ids of different chunks; those that are not remembered are merged together, a rule of each at a time."""
        if len(self) > REMEMBERED:
            self.clear()
        ids = list(map(self.get, chunks))
        new = [k for k, x in enumerate(ids) if x is None]
        if len(new) and self.rank:
            spelled = [chunks[k].encode() for k in new]
            flat, sizes = self._merged(np.frombuffer(b"".join(spelled), np.uint8).astype(np.int64), np.array([len(x) for x in spelled]))
            every, ends = flat.tolist(), np.cumsum(sizes).tolist()
            for k, a, z in zip(new, [0, *ends], ends):
                ids[k] = every[a:z]
                if len(chunks[k]) <= 64:
                    self[chunks[k]] = ids[k]
        return [self[c] if x is None else x for c, x in zip(chunks, ids)]

    def _merged(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `merged`, for many chunks end to end: in each round every chunk that still has a pair merges its first one."""
        keys, ranks = self.pairs
        none = np.int64(1 << 60)
        done_at, done, owner_of = [], [], np.arange(len(sizes))
        ids, owner = flat, np.repeat(owner_of, sizes)
        while len(ids):
            pair = ids[:-1] << 32 | ids[1:]
            at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            rank = np.where((keys[at] == pair) & (owner[:-1] == owner[1:]), ranks[at], none)
            rank = np.append(rank, none)
            heads = np.flatnonzero(np.diff(owner, prepend=-1))
            n = np.diff(np.append(heads, len(ids)))
            best = np.repeat(np.minimum.reduceat(rank, heads), n)
            over = best == none
            done.append(ids[over])
            done_at.append(owner[over])
            hit = np.flatnonzero((rank == best) & ~over)
            if len(hit):  # in a run of one id, every other place from the left
                first = np.diff(hit, prepend=-2) != 1
                hit = hit[(hit - hit[first][np.cumsum(first) - 1]) % 2 == 0]
            ids = ids.copy()
            ids[hit] = 256 + rank[hit]
            over[hit + 1] = True
            ids, owner = ids[~over], owner[~over]
        where = np.concatenate([*done_at, np.zeros(0, np.int64)])
        order = np.argsort(where, kind="stable")
        return np.concatenate([*done, np.zeros(0, np.int64)])[order], np.bincount(where, minlength=len(sizes))

    def column(self, chunks: pa.Array) -> pa.Array:
        """Ids of lists of chunks, one chunk after another; a null list is an empty one. A chunk that recurs among them is looked up once."""
        each = chunks.flatten().dictionary_encode()
        ids = self.all(each.dictionary.to_pylist())
        flat, n = np.fromiter(itertools.chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))
        at = each.indices.to_numpy()
        size, start = n[at], (np.cumsum(n) - n)[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        values = flat[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
        lists = np.cumsum(pc.fill_null(pc.list_value_length(chunks), 0).to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(ends[np.concatenate([[0], lists]).astype(np.int64)].astype(np.int32)), pa.array(values))


def encoded(docs: DataFrame, key: str, text: str, merges: Merges, pattern: str = "isolating", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, ids); the split runs in the JVM, a worker merges a chunk that recurs only once."""
    schema = docs.select(key, *keep).withColumn("ids", F.array(F.lit(0))).schema

    def run(batches):
        encoder = Encoder(merges)
        for b in slices(batches, -1):
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], encoder.column(b.column(b.num_columns - 1))], names=[key, *keep, "ids"])

    return docs.select(key, *keep, pretokens(F.col(text), pattern).alias("chunks")).mapInArrow(run, schema)


def decoded(df: DataFrame, key: str, ids: str, merges: Merges, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, text); bytes that aren't UTF-8 become replacement characters."""
    tokens = token_bytes(merges)
    schema = df.select(key, *keep).withColumn("text", F.lit("")).schema

    def run(batches):
        for b in slices(batches, -1):
            texts = [b"".join(tokens[i] for i in x or ()).decode(errors="replace") for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[key, *keep, "text"])

    return df.select(key, *keep, ids).mapInArrow(run, schema)


def vocabulary(spark, merges: Merges) -> DataFrame:
    rows = [(i, bytearray(t)) for i, t in enumerate(token_bytes(merges))]
    return spark.createDataFrame(rows, "id int, token binary")
