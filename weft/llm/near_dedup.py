"""MinHash near-duplicates by an inverted join of signature coordinates.

Every distinct shingle set gets a signature of `coordinates` minima. Two sets of the wanted similarity agree in
at least `matches` coordinates but for a chance of about 1e-6 at the threshold itself. Each set posts itself under
its (coordinate, value) pairs; pairs are ordered by how many sets carry them, rarest first, and a set posts only
the first `coordinates - matches + 1`: two sets with `matches` common pairs always meet in one of those (prefix
merging), and a set whose prefix holds only pairs of its own is skipped altogether. The collisions of two sets that
meet are counted over all their coordinate-value pairs, in the one list of those they share in which they meet
first; the others skip them. Those above the match threshold go on: longer signatures, of which the posted
coordinates are the beginning, and at last the full shingle sets confirm them.

Members of a posting list aren't all paired. In a leader round each is paired with a few leaders of its list, and
confirmed links join them; lists whose members are in one component by then need nothing more. What is left is
compared in blocks inside the executors, and only pairs of different components that pass the count come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.components import components
from weft.llm.scratch import Scratch
from weft.llm.words import U, bytes_of, grams, mix, signed, slabs, words_of

_ODD = (np.random.default_rng(7).integers(0, 2**63, 1024, dtype=np.uint64) << U(1)) | U(1)
_XOR = np.random.default_rng(11).integers(0, 2**63, 1024, dtype=np.uint64)
#: Members of a posting list that one task compares with as many others.
BLOCK = 1024
#: Coordinates, one byte each, of the longer signatures by which members of a posting list are compared.
WIDE = 512
#: Lists whose members' incidence is held at once.
LISTS = 2048
#: Shingles whose minima are taken in one piece.
_PIECE = 1 << 10


def shingle_sets(batch: pa.RecordBatch, text: int, k: int, lower: bool) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a batch."""
    data, places = bytes_of(batch.column(text))
    words, _, _, first = words_of(data, places, lower)
    runs = grams(words, k)
    for i in range(batch.num_rows):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            yield np.unique(runs[a : b - k + 1])
        else:
            yield grams(words[a:b], int(b - a), 1) if b > a else np.zeros(0, np.uint64)


def minima(shingles: np.ndarray, n: int) -> np.ndarray:
    """Signature: for each coordinate, the smallest value that any shingle takes there."""
    out = np.full(n, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), _PIECE):
        np.minimum(out, ((shingles[i : i + _PIECE, None] ^ _XOR[:n]) * _ODD[:n]).min(0), out=out)
    return out


def _signer(k: int, lower: bool, n: int):
    import hashlib

    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sig", pa.binary())])

    def run(batches):
        for whole in batches:
            for batch in slabs(whole, 1):
                size, digest, sigs = [], [], []
                for s in shingle_sets(batch, 1, k, lower):
                    size.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sigs.append(minima(s, n).tobytes() if len(s) else None)
                d = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(sigs, pa.binary())], schema=schema)

    return run


def _set_maker(k: int, lower: bool):
    schema = pa.schema([("c", pa.int64()), ("shingles", pa.binary()), ("sig", pa.binary())])

    def run(batches):
        for whole in batches:
            for batch in slabs(whole, 1):
                sets = [*shingle_sets(batch, 1, k, lower)]
                sigs = [minima(s, WIDE).astype(np.uint8).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(sigs, pa.binary())], schema=schema)

    return run


def _exploder(n: int):
    """A row per coordinate-value pair; the pair is written as one 64-bit number."""
    schema = pa.schema([("c", pa.int64()), ("pair", pa.int64())])
    salt = mix(np.arange(n, dtype=np.uint64), 3)

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, n)
                c = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), n)
                yield pa.RecordBatch.from_arrays([pa.array(c), signed(mix(sig ^ salt).ravel())], schema=schema)

    return run


def least_matches(n: int, percent: int, deviations: float, chance: float = 0.0) -> int:
    """Agreements among n coordinates that a pair right at the threshold reaches but for `deviations` of bad luck."""
    p = percent / 100
    return int(n * (p + (1 - p) * chance) - deviations * (n * p * (1 - p)) ** 0.5)


def collisions(own: np.ndarray, other: np.ndarray, n: int, matches: int, alike: int) -> np.ndarray:
    """Agreements of each row of `own` with `other` over the whole signature; 0 unless those of the n posted
    coordinates reach `matches` and all of them `alike`."""
    equal = own == other
    m = equal.sum(1)
    return np.where((equal[:, :n].sum(1) >= matches) & (m >= alike), m, 0)


def _counter(n: int, matches: int, alike: int):
    """Counts each member's collisions with its list's leaders; keeps those that agree often enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("m", pa.int32())])

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                c, comp = (batch.column(i).to_numpy() for i in (0, 1))
                own = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, WIDE)
                found = []
                for i in range(3, batch.num_columns):
                    head = batch.column(i)
                    lead, lead_comp = head.field("c").to_numpy(), head.field("comp").to_numpy()
                    m = collisions(own, np.frombuffer(b"".join(head.field("sig").to_pylist()), np.uint8).reshape(-1, WIDE), n, matches, alike)
                    keep = np.flatnonzero((m > 0) & (comp != lead_comp))
                    found.append(np.stack([np.minimum(c, lead)[keep], np.maximum(c, lead)[keep], m[keep]]))
                a, b, m = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(m.astype(np.int32))], schema=schema)

    return run


def _confirmer(percent: int):
    """Keeps (a, b) whose full sets are similar enough: 100 * intersection >= percent * union."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(j)[i].as_buffer(), np.uint64) for j in (2, 3))
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], schema=schema)

    return run


def _block_pairs(n: int, matches: int, alike: int):
    """Within one pair of blocks of a posting list: pairs of different components that collide often enough.

    Two members that share several open lists are compared in the one of least number only: which those are is seen
    at once for the whole block, from a product of the members' incidence with the lists before this one.
    """

    def run(table: pa.Table) -> pa.Table:
        c, comp, part = (table.column(x).to_numpy() for x in ("c", "comp", "part"))
        this = table.column("pair")[0].as_py()
        lists = table.column("lists").combine_chunks()
        member = np.repeat(np.arange(len(c)), np.diff(lists.offsets.to_numpy()))
        name = lists.flatten().to_numpy()
        before = name < this
        found, column = np.unique(name[before], return_inverse=True)
        some = np.flatnonzero(np.bincount(column, minlength=len(found)) > 1)
        place = np.full(len(found), -1)
        place[some] = np.arange(len(some))
        row, at = member[before], place[column]
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, WIDE)
        left, right = np.flatnonzero(part != 1), np.flatnonzero(part != 0)
        met = np.zeros((len(left), len(right)), bool)
        for lo in range(0, len(some), LISTS):
            held = (at >= lo) & (at < lo + LISTS)
            incidence = np.zeros((len(c), min(LISTS, len(some) - lo)), np.float32)
            incidence[row[held], at[held] - lo] = 1
            met |= incidence[left] @ incidence[right].T > 0
        a, b = [], []
        for i, seen in zip(left, met):
            other = right[~seen & (comp[right] != comp[i]) & ((part[right] == 1) | (c[right] > c[i]))]
            for j in other[collisions(sig[other], sig[i], n, matches, alike) > 0]:
                a.append(min(c[i], c[j]))
                b.append(max(c[i], c[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    lower: bool = False,
    coordinates: int = 96,
    leaders: int = 2,
    rounds: int = 2,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id, component_id, kept.

    class_id is the smallest doc_id with the same shingle set, component_id the smallest one reachable over links
    (itself included), kept whether that is the document's own. A set is the distinct runs of `shingle` words; with
    fewer words the whole sequence is the one shingle; null, empty and blank texts have an empty set and no links.
    Documents that share a doc_id count as one node. A null doc_id takes no part: its class and component are null
    and it is kept. Other columns of `docs`, whatever their names, are not read.
    """
    matches = least_matches(coordinates, percent, 3.8)
    alike = least_matches(WIDE, percent, 4.0, 1 / 256)
    tmp = Scratch(docs.sparkSession, "near")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed_rows = tmp.keep(rows.mapInArrow(_signer(shingle, lower, coordinates), "doc_id long, n long, d1 long, d2 long, sig binary"), "signatures")
    sets = signed_rows.where("n > 0 and doc_id is not null")
    classes = tmp.keep(sets.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("c"), F.first("sig").alias("sig")), "classes")
    member = signed_rows.select("doc_id", "n", "d1", "d2").join(classes.select("d1", "d2", "n", "c"), ["d1", "d2", "n"], "left")

    pairs = classes.select("c", "sig").mapInArrow(_exploder(coordinates), "c long, pair long")
    often = tmp.keep(pairs.groupBy("pair").agg(F.count("*").alias("f")).where("f > 1"), "often")
    # Pairs that nobody shares come first in the order; only their number matters.
    shared = pairs.join(often, "pair")
    own = Window.partitionBy("c")
    ranked = shared.withColumn("r", F.row_number().over(own.orderBy("f", "pair"))).withColumn("m", F.count("*").over(own))
    posted = tmp.keep(ranked.where(F.col("r") + coordinates - F.col("m") <= coordinates - matches + 1).select("c", "pair"), "posted")

    wanted = posted.select("c").distinct()
    full = tmp.keep(rows.join(wanted, rows.doc_id == wanted.c, "left_semi").mapInArrow(_set_maker(shingle, lower), "c long, shingles binary, sig binary"), "full")
    sig = full.select("c", "sig")

    def confirmed(found: DataFrame) -> DataFrame:
        both = found
        for side in ("a", "b"):
            both = both.join(full.select(F.col("c").alias(side), F.col("shingles").alias(f"shingles_{side}")), side)
        return both.select("a", "b", "shingles_a", "shingles_b").mapInArrow(_confirmer(percent), "a long, b long")

    links = None
    comp = None
    for k in range(rounds):
        at = posted if comp is None else posted.join(comp.withColumnRenamed("node", "c"), "c", "left")
        at = at.withColumn("comp", F.col("c") if comp is None else F.coalesce("component", "c"))
        order = lambda i: F.struct((F.col("c") if k + i == 0 else F.xxhash64("c", F.lit(k * leaders + i))).alias("key"), "c", "comp")
        heads = at.groupBy("pair").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *(F.min(order(i)).alias(f"h{i}") for i in range(leaders))).where("lo < hi")
        for i in range(leaders):
            one = sig.select(F.col("c").alias("hc"), F.col("sig").alias("hs"))
            heads = heads.join(one, F.col(f"h{i}.c") == F.col("hc")).withColumn(f"h{i}", F.struct(F.col(f"h{i}.c").alias("c"), F.col(f"h{i}.comp").alias("comp"), F.col("hs").alias("sig"))).drop("hc", "hs")
        heads = tmp.keep(heads.select("pair", *(f"h{i}" for i in range(leaders))), f"heads{k}")
        tried = at.join(heads, "pair").join(sig, "c").select("c", "comp", "sig", *(f"h{i}" for i in range(leaders)))
        tried = tried.mapInArrow(_counter(coordinates, matches, alike), "a long, b long, m int").distinct()
        # A member goes on with its most similar leaders only; what that leaves open is left to what follows.
        best = tmp.keep(tried.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("m"), "a"))).where("r <= 2").select("a", "b"), f"best{k}")
        new = tmp.keep(confirmed(best), f"links{k}")
        links = new if links is None else links.union(new)
        comp = components(links, "a", "b", tmp, f"cc{k}")

    at = posted.join(comp.withColumnRenamed("node", "c"), "c", "left").withColumn("comp", F.coalesce("component", "c"))
    open_lists = tmp.keep(at.groupBy("pair").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("pair", "size"), "open")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rest = at.join(open_lists, "pair").withColumn("blocks", blocks).withColumn("x", F.pmod(F.xxhash64("c"), "blocks").cast("int"))
    # A member of block x goes to (x, x) and to every (x, y) and (y, x), in which it stands left or right.
    spread = F.expr("transform(sequence(0, blocks - 1), y -> struct(least(x, y) as lo, greatest(x, y) as hi, cast(if(x = y, 2, if(x < y, 0, 1)) as int) as part))")
    rest = rest.select("c", "comp", "pair", F.explode(spread).alias("s")).select("c", "comp", "pair", "s.lo", "s.hi", "s.part")
    rest = rest.join(posted.join(open_lists, "pair", "left_semi").groupBy("c").agg(F.collect_list("pair").alias("lists")), "c").join(sig, "c")
    more = rest.groupBy("pair", "lo", "hi").applyInArrow(_block_pairs(coordinates, matches, alike), "a long, b long")
    links = links.union(tmp.keep(confirmed(tmp.keep(more, "more")), "links-more"))
    comp = components(links, "a", "b", tmp, "cc")

    out = member.join(comp.withColumnRenamed("node", "c"), "c", "left")
    known = F.col("doc_id").isNotNull()
    component = F.when(known, F.coalesce("component", "c", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(known, F.coalesce("c", "doc_id")).alias("class_id"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
