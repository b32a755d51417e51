"""What a worker holds as Python objects doesn't grow with the rows of an Arrow batch."""

import pyarrow as pa
from pyspark.sql import functions as F

from weft.plans import bpe
from weft.sources import shared


def test_slices_are_bounded_and_whole():
    lists = [[1] * n for n in (0, 5, shared.AT_ONCE + 3, 0)] + [[2] * 1000] * 300 + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.int32()))], names=["k", "x"])
    out = list(shared.slices([batch, batch.slice(0, 0), batch.slice(3)], -1))
    assert [x for b in out for x in b.column(1).to_pylist()] == lists + lists[3:]
    assert all(b.num_rows == 1 or sum(len(x or ()) for x in b.column(1).to_pylist()) <= shared.AT_ONCE for b in out)
    texts = pa.RecordBatch.from_arrays([pa.array(["é" * 20_000, None, "", "a" * 40_000, "b"])], names=["t"])
    assert [b.num_rows for b in shared.slices([texts], 0)] == [3, 2]


def test_large_batches_are_encoded_in_slices(spark):
    """Ids of one batch come back in several: no list of all of them is made."""
    docs = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("ab c "), 20).alias("text"))
    sizes = bpe.encoded(docs, "id", "text", [(97, 98)]).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in bs), "n long")
    assert sum(r["n"] for r in sizes.collect()) == 4000
    seen = []
    rows = shared.slices([pa.RecordBatch.from_arrays([pa.array([[0] * 80] * 4000, pa.list_(pa.int32()))], names=["c"])], 0)
    seen += [b.num_rows for b in rows]
    assert len(seen) > 3 and sum(seen) == 4000 and max(seen) * 80 <= shared.AT_ONCE


def test_id_queries_hold_small_batches(spark, tmp_path):
    """Three Python workers in a row each hold a batch; of Spark's size before."""
    from weft.plans import ids

    spark.createDataFrame([(1, "en", "a b")], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    ids.id_bytes(spark, str(tmp_path))
    assert int(spark.conf.get(name)) == shared.BATCH_BYTES
    spark.conf.unset(name)
