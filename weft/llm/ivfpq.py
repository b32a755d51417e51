"""Inverted lists of coarse centroids with product-quantised residuals, for search and for near-duplicates.

The coarse centroids and the codebooks are fitted on a bounded sample; every row is indexed. A shard holds the rows
of some lists, a large list being split over several by a hash, so that no shard outgrows a task. Queries go to the
shards that hold lists they probe, and only there; a shard that very many ask is read once for each block of
`QUERIES` of them. Inside, tables of the query's products with the codebooks give asymmetric scores by lookup, and
the few rows that remain are compared by their original vectors. Vectors of different dimensions can't be compared;
each dimension has an index of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.components import components
from weft.llm.scratch import Scratch

#: Rows that centroids and codebooks are fitted on, at most, chosen by a hash of the id.
SAMPLE = 16_384
#: Codewords of a codebook; a code is a byte.
CODES = 256
#: Rows of a shard and queries of a block, about, and queries whose scores are held at once.
SHARD, QUERIES, HELD = 8192, 4096, 256
#: Standard errors of an asymmetric score by which a row may fall short of the k-th best and still be compared exactly.
MARGIN = 4.0


def usable(vector: Column) -> Column:
    """Not null or empty, every component a finite number, not all zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all lists of one length, as a matrix of doubles."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm; an empty cluster takes a row at random."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[rng.integers(0, len(x), len(centres))])
    return centres


class Index:
    """Coarse centroids and residual codebooks; of bounded size, and sent to the executors with the functions."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int):
        d = sample.shape[1]
        self.parts = min(parts, d)
        self.cuts = np.linspace(0, d, self.parts + 1).astype(int)
        self.centres = kmeans(sample, max(1, lists), 8, 1)
        rest = (sample - self.centres[nearest(sample, self.centres)])[: SAMPLE // 2]
        self.books = [kmeans(rest[:, a:b], CODES, 5, 2 + i) for i, (a, b) in enumerate(zip(self.cuts, self.cuts[1:]))]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = nearest(x, self.centres)
        rest = x - self.centres[own]
        return own, np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], axis=1).astype(np.uint8)

    def decode(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.centres[own] + np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each part, the product of every query with every codeword."""
        return [q[:, a:b] @ book.T for a, b, book in zip(self.cuts, self.cuts[1:], self.books)]

    def products(self, tables: list[np.ndarray], own: np.ndarray, q: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric inner products of the queries `own` with coded rows of the list `at`."""
        out = np.repeat((q[own] @ self.centres[at])[:, None], len(codes), axis=1)
        for table, code in zip(tables, codes.T):
            out += np.take(table[own], code, axis=1)
        return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows over their greatest component: the order of a query's products stays, and none is too large."""
    return x / np.abs(x).max(1, keepdims=True) if len(x) else x


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one."""
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True)) if len(x) else x


def sampled(rows: DataFrame, rng: int = 0) -> tuple[np.ndarray, int]:
    """At most SAMPLE vectors of (vec_id, v), chosen by a hash, and the number of rows."""
    n = rows.count()
    share = min(1.0, 1.2 * SAMPLE / max(n, 1))
    key = F.pmod(F.xxhash64("vec_id", F.lit(rng)), F.lit(2**30))
    got = rows.where(key < int(share * 2**30)).select("vec_id", key.alias("key"), "v").toPandas().sort_values(["key", "vec_id"]).head(SAMPLE)
    return (np.array(got["v"].tolist(), np.float64) if len(got) else np.zeros((0, 1))), n


def vectors(df: DataFrame, id_col: str, vector_col: str, *extra: str) -> DataFrame:
    """(vec_id, v, d, ...) of the usable rows with an id; d is the dimension. Floats stay floats on their way."""
    kind = "array<float>" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"), *extra)
    return rows.where(F.col("vec_id").isNotNull() & usable(F.col("v"))).withColumn("d", F.size("v"))


def dimensions(rows: DataFrame) -> list[int]:
    """The dimensions that occur; few, as each is a kind of embedding."""
    return sorted(r["d"] for r in rows.select("d").distinct().collect())


def probes_for(index: Index, sample: np.ndarray, k: int, target: float) -> int:
    """Lists to probe so that, within the sample, `target` of the k nearest lie in them."""
    q = sample[: min(400, len(sample))]
    scores = q @ sample.T
    scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(index.centres)
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    rank = np.empty((len(q), len(index.centres)), np.int64)
    np.put_along_axis(rank, np.argsort(-(q @ index.centres.T), axis=1), np.arange(len(index.centres)), axis=1)
    need = np.sort(np.take_along_axis(rank, nearest(sample, index.centres)[best], axis=1).ravel())
    return int(need[min(len(need) - 1, int(np.ceil(target * len(need))) - 1)]) + 1


def _encoded(index: Index, prepared):
    def run(batches):
        for b in batches:
            x = prepared(matrix(b.column(1)))
            own, codes = index.encode(x) if len(x) else (np.zeros(0, np.int64), np.zeros((0, index.parts), np.uint8))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "list", "code"])

    return run


def search(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, parts: int = 32, recall: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `queries` the k rows of `df` of largest inner product, its own id excepted.

    Scores are inner products of the original vectors in double precision; ties go to the smaller vec_id. Null, zero
    and non-finite vectors and null ids take no part; a vector is compared with those of its dimension. The lists to
    probe are as many as hold `recall` of the nearest neighbours within the sample, and more for a query whose lists
    hold no more than k rows. In each shard the rows whose asymmetric score is within MARGIN standard errors of the
    k-th best are compared exactly, however many they are. With fewer candidates than k, all come out. Rows that
    repeat an id count once, by the least vector. Products too large for a double are infinite, and tie.
    """
    tmp = Scratch(df.sparkSession, "ann")
    once = lambda x: x.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))
    rows = tmp.keep(once(vectors(df, id_col, vector_col)), "rows")
    wanted = vectors(queries, id_col, vector_col).select("vec_id").distinct()
    wanted = tmp.keep(rows.join(wanted, "vec_id", "left_semi"), "queries")
    out = None
    for d in dimensions(wanted):
        one = _search(tmp, f"-{d}", rows.where(F.col("d") == d).select("vec_id", "v"), wanted.where(F.col("d") == d).select("vec_id", "v"), k, parts, recall)
        out = one if out is None else out.union(one)
    return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def _search(tmp: Scratch, name: str, rows: DataFrame, wanted: DataFrame, k: int, parts: int, recall: float) -> DataFrame:
    """The search among vectors of one dimension."""
    greatest = rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    sample, n = sampled(rows)
    prepared = lambda x: x / greatest
    index = Index(prepared(sample), int(min(1024, max(1, n**0.5 / 4))), parts)
    probes = probes_for(index, prepared(sample), k, recall)
    coded = tmp.keep(rows.mapInArrow(_encoded(index, prepared), "vec_id long, list int, code binary").join(rows, "vec_id"), f"coded{name}")

    shards = -(-n // SHARD)
    counts = np.zeros(len(index.centres), np.int64)
    for r in coded.groupBy("list").count().collect():  # at most 1024 rows
        counts[r["list"]] = r["count"]
    split = [max(1, -(-int(c) // (SHARD // 4))) for c in counts]
    chunk = F.pmod(F.xxhash64("vec_id"), F.element_at(F.array(*map(F.lit, split)), F.col("list") + 1))
    coded = coded.withColumn("shard", F.pmod(F.xxhash64("list", chunk), F.lit(shards)).cast("int"))

    def probed(q: np.ndarray) -> np.ndarray:
        """Whether each query probes each list: the nearest `probes`, and on until they hold more than k rows."""
        order = np.argsort(-(q @ index.centres.T), axis=1, kind="stable")
        enough = np.cumsum(counts[order], axis=1) > k
        many = np.maximum(probes, np.where(enough.any(1), enough.argmax(1) + 1, order.shape[1]))
        out = np.empty(order.shape, bool)
        np.put_along_axis(out, order, np.arange(order.shape[1]) < many[:, None], axis=1)
        return out

    def route(batches):
        for b in batches:
            if b.num_rows:
                q, c = np.nonzero(probed(scaled(matrix(b.column(1)))))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(q)), pa.array(c.astype(np.int32))], names=["query_id", "list"])

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if left.num_rows and right.num_rows:
            ids, lists = left.column("vec_id").to_numpy(), left.column("list").to_numpy()
            codes = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            x = matrix(left.column("v").combine_chunks())
            error = np.sqrt(((prepared(x) - index.decode(lists, codes)) ** 2).sum(1)).max()
            held = [(c, np.flatnonzero(lists == c)) for c in np.unique(lists)]
            every_id, every = right.column("query_id").to_numpy(), matrix(right.column("q").combine_chunks())
            for at in range(0, len(every), HELD):
                qid, original = every_id[at : at + HELD], every[at : at + HELD]
                q = scaled(original)
                slack = (2 * MARGIN / x.shape[1] ** 0.5) * error * np.sqrt((q * q).sum(1))
                may, tables = probed(q), index.tables(q)
                scores = np.full((len(q), len(ids)), -np.inf)
                for c, there in held:
                    own = np.flatnonzero(may[:, c])
                    if len(own):
                        scores[np.ix_(own, there)] = index.products(tables, own, q, c, codes[there])
                scores[qid[:, None] == ids] = -np.inf
                m = min(k, len(ids))
                least = np.partition(scores, len(ids) - m, axis=1)[:, len(ids) - m] - slack
                for i in range(len(q)):
                    hit = np.flatnonzero((scores[i] >= least[i]) & (scores[i] > -np.inf))
                    with np.errstate(over="ignore", invalid="ignore"):
                        exact = (x[hit] * original[i]).sum(1)
                    best = np.lexsort((ids[hit], -exact))[:k]
                    for column, value in zip(out, (np.full(len(best), qid[i]), ids[hit][best], exact[best])):
                        column.append(value)
        return pa.table([pa.array(np.concatenate(x)) for x in out], names=["query_id", "vec_id", "score"])

    homes = tmp.keep(coded.select("list", "shard").distinct(), f"homes{name}")
    asked = tmp.keep(wanted.mapInArrow(route, "query_id long, list int").join(homes, "list").select("query_id", "shard").distinct(), f"asked{name}")
    deal = tmp.keep(asked.groupBy("shard").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks")), f"deal{name}")
    asked = asked.join(deal, "shard").withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(3)), "blocks").cast("int"))
    asked = asked.join(wanted.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id").select("shard", "block", "query_id", "q")
    spread = coded.join(deal, "shard").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks")
    found = spread.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(scan, "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, parts: int = 16) -> DataFrame:
    """A row per row of `df`: vec_id, n_links, component_id, kept; linked are vectors of one label with at least that cosine.

    Equal vectors of a label are one class, which stands for all its copies: nothing is made for pairs of copies.
    Lists to probe and rows to compare exactly are bounded below by what geometry allows (the bisecting planes of the
    centroids, each row's own quantisation error), so that no link is missed. Links are counted where they are
    found; of a block's links only a spanning forest goes on to the components.
    A null label, a null, zero or non-finite vector: no links, its own component. Vectors of different dimensions
    aren't linked. A null vec_id has null as its component, no links, and is kept. Rows that repeat a vec_id stand
    each for itself: with other vectors or labels they have other links and, it may be, another component.
    """
    tmp = Scratch(df.sparkSession, "vecdup")
    rows = tmp.keep(vectors(df.where(F.col(label_col).isNotNull()), id_col, vector_col, F.col(label_col).cast("string").alias("label")), "rows")
    # A class has a number of its own as its vec_id here, since the ids of its rows may stand in other classes too.
    classes = rows.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = tmp.keep(classes.withColumn("d", F.size("v")).withColumn("vec_id", F.monotonically_increasing_id()), "classes")
    own = df.select(F.col(id_col).cast("long").alias("vec_id"))
    found = None
    for d in dimensions(classes):
        one = _links(tmp, f"-{d}", classes.where(F.col("d") == d).drop("d"), cosine, parts)
        found = one if found is None else found.union(one)
    if found is None:
        return own.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    comp = components(found.where("other is not null"), "vec_id", "other", tmp)
    degree = found.where("other is null").groupBy("vec_id").agg(F.sum("links").alias("links"))
    least = comp.join(classes.select(F.col("vec_id").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    comp = comp.join(tmp.keep(least, "least"), "component").select(F.col("node").alias("vec_id"), "component_id")
    known = classes.join(degree, "vec_id", "left").join(comp, "vec_id", "left")
    known = known.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    linked = rows.join(tmp.keep(known, "known"), ["label", "v"]).select("vec_id", "n_links", "component_id")
    unlinked = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    unlinked = unlinked.where(F.col("label").isNull() | F.col("vec_id").isNull() | ~usable(F.col("v")))
    out = linked.union(unlinked.select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _links(tmp: Scratch, name: str, classes: DataFrame, cosine: float, parts: int) -> DataFrame:
    """(vec_id, other, links) among classes of one dimension: with `other` an edge of a forest, without it a number of links."""
    sample, n = sampled(classes)
    index = Index(unit(sample), int(min(256, max(1, n**0.5 / 4))), parts)
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-6
    gaps = 2 * np.maximum(np.sqrt(np.maximum(0, ((index.centres[:, None] - index.centres[None]) ** 2).sum(2))), 1e-9)

    def probed(x: np.ndarray) -> np.ndarray:
        """Lists that can hold a vector within the radius: its distance to the plane between its list and theirs is less."""
        far = -2 * x @ index.centres.T + (index.centres**2).sum(1)
        mine = far.argmin(1)
        return (far - far[np.arange(len(x)), mine][:, None]) / gaps[mine] <= radius

    size = 2048
    sizes = tmp.keep(classes.groupBy("label").agg(F.count("*").alias("n_label")).withColumn("shards", F.ceil(F.col("n_label") / size).cast("int")), f"sizes{name}")
    coded = tmp.keep(classes.select("vec_id", "v").mapInArrow(_encoded(index, unit), "vec_id long, list int, code binary").join(classes, "vec_id"), f"coded{name}")
    # Lists of a label stay together where they fit; a larger one is dealt out by a hash.
    parts_of = tmp.keep(coded.groupBy("label", "list").agg(F.count("*").alias("n_list")).withColumn("split", F.ceil(F.col("n_list") / (size // 4)).cast("int")), f"parts{name}")
    placed = coded.join(parts_of.select("label", "list", "split"), ["label", "list"]).join(sizes.select("label", "shards"), "label")
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), "split").cast("int")).withColumn("shard", F.pmod(F.xxhash64("list", "chunk"), "shards").cast("int"))
    placed = tmp.keep(placed.select("vec_id", "v", "label", "copies", "list", "code", "shard"), f"placed{name}")
    where = tmp.keep(placed.select("label", "list", "shard").distinct(), f"where{name}")

    def targets(batches):
        for b in batches:
            x = unit(matrix(b.column(1)))
            if len(x):
                q, c = np.nonzero(probed(x))
                at = pa.array(q)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(c.astype(np.int32))], names=["vec_id", "label", "list"])

    to = classes.select("vec_id", "v", "label").mapInArrow(targets, "vec_id long, label string, list int").join(where, ["label", "list"]).select("vec_id", "label", "shard").distinct()
    to = tmp.keep(to, f"asked{name}")
    deal = tmp.keep(to.groupBy("label", "shard").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks")), f"deal{name}")
    asked = to.join(deal, ["label", "shard"]).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), "blocks").cast("int"))
    asked = asked.join(classes.select("vec_id", F.col("v").alias("q")), "vec_id").select("label", "shard", "block", F.col("vec_id").alias("query_id"), "q")
    spread = placed.join(deal, ["label", "shard"]).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).select("label", "shard", "block", "vec_id", "v", "copies", "list", "code")
    schema = pa.schema([("vec_id", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ids, copies, lists, qid = (t.column(x).to_numpy() for t, x in ((left, "vec_id"), (left, "copies"), (left, "list"), (right, "query_id")))
        codes = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        x, q = unit(matrix(left.column("v").combine_chunks())), unit(matrix(right.column("q").combine_chunks()))
        decoded = index.decode(lists, codes)
        error = np.sqrt(((x - decoded) ** 2).sum(1))
        norm = (decoded**2).sum(1)
        held = [(c, np.flatnonzero(lists == c)) for c in np.unique(lists)]
        linked = np.zeros((len(q), len(ids)), bool)
        for at in range(0, len(q), HELD):
            some = q[at : at + HELD]
            may, tables = probed(some), index.tables(some)
            for c, there in held:
                own = np.flatnonzero(may[:, c])
                if len(own):
                    far = 1 + norm[there] - 2 * index.products(tables, own, some, c, codes[there])
                    a, b = np.nonzero(far <= (radius + error[there]) ** 2 + 1e-4)
                    a, b = own[a] + at, there[b]
                    for lo in range(0, len(a), 1 << 15):
                        i, j = a[lo : lo + (1 << 15)], b[lo : lo + (1 << 15)]
                        ok = ((q[i] * x[j]).sum(1) >= cosine) & (qid[i] != ids[j])
                        linked[i[ok], j[ok]] = True
        links = linked @ copies
        edges_a, edges_b = _forest(linked)
        counted = np.flatnonzero(links)
        return pa.table(
            [pa.array(np.concatenate([qid[counted], qid[edges_a]])), pa.array(np.concatenate([np.full(len(counted), -1), ids[edges_b]]), mask=np.arange(len(counted) + len(edges_a)) < len(counted)), pa.array(np.concatenate([links[counted], np.zeros(len(edges_a), np.int64)]))],
            schema=schema,
        )

    return tmp.keep(spread.groupBy("label", "shard", "block").cogroup(asked.groupBy("label", "shard", "block")).applyInArrow(compare, "vec_id long, other long, links long"), f"found{name}")


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, column) that span the components of a bipartite graph: at most rows + columns of them."""
    n, m = linked.shape
    row_new, col_new = linked.any(1), linked.any(0)
    a, b = [], []
    while row_new.any():
        start = int(row_new.argmax())
        row_new[start] = False
        front = [start]
        while front:
            nxt = []
            for i in front:
                cols = np.flatnonzero(linked[i] & col_new)
                if len(cols):
                    col_new[cols] = False
                    a.append(np.full(len(cols), i))
                    b.append(cols)
                    sub = linked[:, cols] & row_new[:, None]
                    rows = np.flatnonzero(sub.any(1))
                    row_new[rows] = False
                    a.append(rows)
                    b.append(cols[sub[rows].argmax(1)])
                    nxt += rows.tolist()
            front = nxt
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))
