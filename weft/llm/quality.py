"""Quality score of a text by how well two zstandard dictionaries compress it.

One dictionary is built from good and one from bad labelled text. A text is compressed with each in pieces of
`PIECE` bytes, so that the dictionaries count for as much at the end of a long text as at its start; the difference
of the two sizes, over their sum and over the length of the text, and the smaller size over the length (texts that
repeat themselves compress to nothing with either) go into a logistic calibration.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.scratch import Scratch

PIECE = 1024
LEVEL = 3
DICTIONARY = 1 << 17
#: Pieces of a text that go into a dictionary's sample.
MOST = 16
#: A text shorter than this counts as this long, so that a few bytes' chance doesn't decide.
SHORT = 64


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


class Classifier:
    """Two dictionaries and a calibration; small, of fixed size, and pickled to the executors."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = good, bad
        self.mean, self.spread, self.weights = np.zeros(3), np.ones(3), np.zeros(4)
        self._ready = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def _compressors(self):
        if self._ready is None:
            self._ready = []
            for data in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(data)
                d.precompute_compress(level=LEVEL)
                self._ready.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_dict_id=False, write_content_size=False))
        return self._ready

    def features(self, text: bytes) -> tuple[float, float, float]:
        good, bad = self._compressors()
        x = y = 0
        for p in pieces(text):
            x += len(good.compress(p))
            y += len(bad.compress(p))
        n = max(len(text), SHORT)
        return (y - x) / max(x + y, 1), (y - x) / n, min(x, y) / n

    def calibrate(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> None:
        """Logistic regression by Newton's method."""
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-6
        z = np.c_[(x - self.mean) / self.spread, np.ones(len(x))]
        w = np.zeros(z.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
        self.weights = w

    def score(self, text: bytes) -> float:
        z = [(a - m) / s for a, m, s in zip(self.features(text), self.mean, self.spread)]
        at = sum(a * b for a, b in zip(z, self.weights)) + self.weights[-1]
        return float(1 / (1 + math.exp(-min(max(at, -30.0), 30.0))))


def dictionary(sample: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, sample).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(sample)[-DICTIONARY:] or b" " * 8


def spread_pieces(text: bytes) -> bytes:
    """Up to `MOST` pieces of a text, evenly from its start to its end, as one run of bytes; short texts whole."""
    n = -(-len(text) // PIECE)
    if n <= MOST:
        return text
    return b"".join(text[i * PIECE : (i + 1) * PIECE].ljust(PIECE) for i in np.linspace(0, n - 1, MOST).astype(int).tolist())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = 3000) -> Classifier | None:
    """Fit on a bounded sample of the labelled rows that aren't held out; None with fewer than four texts of a class.

    `per_class` labelled ids of each class, chosen by a hash, one text for each id (of rows that repeat an id, the least).
    Half of them makes the dictionaries, from at most `MOST` pieces of each text, which come to the driver: so many bytes
    at most, however long the texts are. The other half calibrates: whole texts are compressed on the executors, and
    three numbers of each come back. Rows with a null id, text or label are not learnt from; an id with both labels is
    left out.
    """
    spark, tmp = docs.sparkSession, Scratch(docs.sparkSession, "quality")
    seen = labels.select(F.col(id_col).cast("long").alias("id"), F.col("quality").cast("int").alias("quality"))
    seen = seen.where(F.col("quality").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    seen = seen.groupBy("id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    chosen = None
    for label in (0, 1):
        one = seen.where(F.col("quality") == label).orderBy(F.xxhash64("id"), "id").limit(per_class)
        chosen = one if chosen is None else chosen.union(one)
    rows = tmp.keep(texts.join(F.broadcast(chosen), "id").groupBy("id", "quality").agg(F.min("text").alias("text")), "texts")
    # In hash order: whether a text goes to a dictionary or to the calibration has nothing to do with its place.
    ids = sorted(((hash_of(r["id"]), r["id"], r["quality"]) for r in rows.select("id", "quality").collect()), key=lambda r: r[:2])
    classes = [[i for _, i, q in ids if q == label] for label in (0, 1)]
    if min(map(len, classes)) < 4:
        return None
    halves = spark.createDataFrame([(i, k % 2) for of in classes for k, i in enumerate(of)], "id long, half int")
    rows = rows.join(F.broadcast(halves), "id").select("id", "quality", "half", F.col("text").cast("binary").alias("text"))

    def sampled(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([spread_pieces(x) for x in b.column(2).to_pylist()], pa.binary())], names=["id", "quality", "text"])

    found = rows.where("half = 0").select("id", "quality", "text").mapInArrow(sampled, "id long, quality int, text binary")
    found = sorted(((hash_of(r["id"]), r["id"], r["quality"], bytes(r["text"])) for r in found.toLocalIterator()), key=lambda r: r[:2])
    bad, good = (dictionary([p for _, _, q, t in found if q == label for p in pieces(t)]) for label in (0, 1))
    model = Classifier(good, bad)

    def measured(batches):
        for b in batches:
            values = [model.features(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([list(v) for v in values], pa.list_(pa.float64()))], names=["id", "quality", "x"])

    found = rows.where("half = 1").select("id", "quality", "text").mapInArrow(measured, "id long, quality int, x array<double>").orderBy("id").collect()
    model.calibrate(np.array([r["x"] for r in found]), np.array([float(r["quality"]) for r in found]))
    return model


def hash_of(i: int) -> int:
    import zlib

    return zlib.crc32(f"{i}/order".encode())


def scored(docs: DataFrame, model: Classifier | None, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score (0 to 1) and the columns of `extra`, a row for each row of `docs`.

    A null text scores as an empty one, a null id stays null, and rows that repeat an id score each by its own text.
    Without a model (nothing to learn from) every score is 0.5. An empty table gives no rows.
    """
    kept = [docs.schema[c] for c in extra]
    schema = docs.select(F.col(id_col).cast("long").alias("doc_id"), *extra, F.lit(0.0).alias("score")).schema

    def run(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1)
            out = [0.5 if model is None else model.score(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.float64())], names=["doc_id", *(f.name for f in kept), "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *extra, F.col(text_col).alias("_text_")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Classifier | None, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """Rows of `docs` whose text scores at least `threshold`, all columns unchanged; without a model, all rows."""
    if model is None:
        return docs
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            keep = [model.score(x.as_buffer().to_pybytes() if x.is_valid else b"") >= threshold for x in b.column(at)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
