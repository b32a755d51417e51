"""Adapters, sinks, guarded vocabularies and score rules on small rows."""

import json
import time

import pytest
from pyspark.sql import functions as F

from weft.functions import affixes, surfaces
from weft.operators import evaluation, sequences
from weft.plans import bpe, contextual, rows
from weft.streaming import documents
from weft.sources import corpus, datasets, sinks


def test_adapters(spark):
    rows = spark.createDataFrame([(" p ", " q", ["", "a", "b"]), ("p", "q", [" "]), (None, None, None)], "passage string, question string, spans array<string>")
    assert [tuple(r) for r in datasets.reading(rows).collect()] == [("Passage: p\n\nQuestion: q\nAnswer:", "a", ["a", "b"])]
    hops = spark.createDataFrame([(["t", "u"], [["x", "y"]], "q", " a "), (["t"], [["x"]], "q", " ")], "titles array<string>, sentences array<array<string>>, question string, answer string")
    assert [tuple(r) for r in datasets.multi_hop(hops).collect()] == [("Passage: t: x y\n\nQuestion: q\nAnswer:", "a", ["a"])]
    assert datasets.programs(spark.createDataFrame([(None, "t")], "prompt string, test string"), "test").collect()[0] == ("", "t")


def test_vocabulary_is_guarded(spark, tmp_path):
    v = spark.createDataFrame([(bytes([i]), i) for i in range(4)], "token binary, rank int")
    datasets.write_vocabulary(v, f"{tmp_path}/v", limit=4)
    assert datasets.read_vocabulary(spark, f"{tmp_path}/v").count() == 4
    assert datasets.special_ids(v, ["<a>", "<b>"]) == {"<a>": 4, "<b>": 5}
    datasets.write_vocabulary(v, f"{tmp_path}/b", buffer=2)
    with pytest.raises(ValueError):
        datasets.read_vocabulary(spark, f"{tmp_path}/b")
    assert datasets.read_vocabulary(spark, f"{tmp_path}/b", allow_buffer=True).count() == 4
    datasets.write_vocabulary(v, f"{tmp_path}/r", limit=3)
    with pytest.raises(ValueError):
        datasets.read_vocabulary(spark, f"{tmp_path}/r")
    with pytest.raises(ValueError):
        datasets.checked_sizes(v, 5)


def test_sinks(spark, tmp_path):
    sinks.write_whole(spark, f"{tmp_path}/a.txt", "é\n")
    assert (tmp_path / "a.txt").read_text() == "é\n"
    with pytest.raises(FileExistsError):
        sinks.write_whole(spark, f"{tmp_path}/a.txt", "b")
    for task in ("one", "two"):
        sinks.write_task(spark, f"{tmp_path}/out", task, {"score": 0.5, "n": 3})
    assert (tmp_path / "out/summary.csv").read_text() == "task,score,n\none,0.5,3\ntwo,0.5,3\n"
    assert json.loads((tmp_path / "out/two.json").read_text()) == {"n": 3, "score": 0.5}
    with pytest.raises(FileExistsError):
        sinks.write_task(spark, f"{tmp_path}/out", "one", {})
    (tmp_path / "s").mkdir()
    (tmp_path / "s/x").write_text("1")
    with pytest.raises(FileNotFoundError):
        sinks.commit(spark, f"{tmp_path}/s", f"{tmp_path}/t", ["x", "y"])
    assert (tmp_path / "s/x").exists()
    (tmp_path / "s/y").write_text("2")
    sinks.commit(spark, f"{tmp_path}/s", f"{tmp_path}/t", ["x", "y"])
    assert [(tmp_path / "t" / n).read_text() for n in "xy"] == ["1", "2"]
    sinks.merge_lines(spark, [("a", "b"), ("ab", "c")], f"{tmp_path}/merges.txt")
    assert [tuple(r) for r in corpus.merges(spark, f"{tmp_path}/merges.txt").collect()] == [("a", "b"), ("ab", "c")]
    entries = spark.createDataFrame([([1], [2], [[0]], "x")], "token_ids array<int>, base_ids array<int>, modifier_rows array<array<int>>, surface string")
    sinks.write_compositions(entries, f"{tmp_path}/c.json", {"modifier_group_sizes": [3], "group_names": ["space"]})
    assert [tuple(r) for r in corpus.compositions(spark, f"{tmp_path}/c.json").collect()] == [([1], [2], [[0]], "x")]
    document = json.loads((tmp_path / "c.json").read_text())
    assert list(document) == ["entries", "group_names", "modifier_group_sizes", "version"]
    assert contextual.Metadata.read(document).entries == [contextual.Entry((1,), (2,), ((0,),), "x")]
    (tmp_path / "s/x").write_text("3")
    sinks.commit(spark, f"{tmp_path}/s", f"{tmp_path}/t", ["x"])
    assert (tmp_path / "t/x").read_text() == "3" and not (tmp_path / "s/x").exists()
    assert sinks.sections("T", {"b": [("x", 1)], "a": []}) == "# T\n\n## a\n\n\n## b\n\n- x: 1\n"
    assert sinks.evaluation_csv([("a", 0.5, 0.25)], 0.25).splitlines()[-1] == "CORE,,0.250000"


def test_readers_of_shards(spark, tmp_path):
    folder = str(tmp_path / "d")
    for k in range(3):
        spark.createDataFrame([(f"{k}-{i}",) for i in range(4)], "text string").coalesce(1).write.parquet(f"{tmp_path}/w{k}")
        (tmp_path / "d").mkdir(exist_ok=True)
        next((tmp_path / f"w{k}").glob("*.parquet")).rename(f"{folder}/shard_{k}.parquet")
    assert [tuple(r) for r in corpus.shards(spark, folder).orderBy("place").collect()] == [(f"shard_{k}.parquet", k) for k in range(3)]
    assert {r["text"][0] for r in corpus.split(spark, folder, "val").collect()} == {"2"}
    rows, groups = corpus.split(spark, folder, "train"), corpus.row_groups(spark, folder)
    both = corpus.document_batches(rows, groups, 0, 1, epochs=2)
    assert both.count() == 16 and corpus.document_batches(rows, groups, 0, 1, epochs=2, resume=(0, "shard_1.parquet", 0)).count() == 8
    assert corpus.document_batches(rows, groups, 0, 1, epochs=2, resume=(0, "shard_0.parquet", 0)).count() == 12
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        corpus.shards(spark, f"{tmp_path}/none")


def test_small_rules(spark):
    df = spark.createDataFrame([("polyAB",), ("donâ€™t â€\u009dx",), ("AbC",)], "t string")
    got = [tuple(r) for r in df.select(surfaces.without_capital_runs(affixes.camel_parts(F.col("t"))), affixes.canonical_punctuation(F.col("t")), surfaces.cap_representable(F.col("t"))).collect()]
    assert got[0] == (["poly", "A", "B"], "polyAB", False)
    assert got[1][1] == "don’t ”x" and got[2][2] is False
    one = spark.range(1)
    rows = lambda x: F.array(*(F.array(*map(F.lit, r)) for r in x))
    match = lambda p, a: one.select(evaluation.modifiers_match(rows(p), rows(a), 1, 0)).first()[0]
    assert match([[1, 0], [2, 5]], [[1, 0], [2, 0]]) and not match([[1, 5], [2, 0]], [[1, 0], [2, 0]]) and not match([[2, 5]], [[2, 4]])
    ids = lambda x: F.array(*map(F.lit, x))
    span = lambda a, b: tuple(one.select(*evaluation.span_of_change(ids(a), ids(b))).first())
    assert span([1, 2], [1, 2, 3]) == (2, 3) and span([1, 9], [1, 5, 6, 9]) == (1, 3) and span([1, 1], [1, 1, 1]) == (2, 3)
    shots = F.array(F.struct(F.lit(" c ").alias("context"), F.lit("d").alias("answer")))
    assert tuple(one.select(*sequences.continuation_prompts(shots, F.lit("q "), F.lit("a"))).first()) == ("c d\n\nq", "c d\n\nq a")
    tokens = spark.createDataFrame([(b"\xc3\xa9",), (b"\xc3",), (b"a",)], "x binary")
    assert [r[0] for r in tokens.select(surfaces.lossy_bytes(F.col("x"))).collect()] == [2, 3, 1]
    variant = one.select(surfaces.relative_transforms(F.lit(True), F.lit("none"), F.lit(False), F.lit("first_cap"))).first()[0]
    assert variant == ["with_space_prefix", "remove_base_capitalization"]


def test_training_rows(spark):
    df = spark.createDataFrame([(1, list(range(10, 17))), (2, [20, 21]), (3, [30]), (4, list(range(40, 60)))], "id long, ids array<int>")
    got = rows.training_rows(df, "id", "ids", 4, 1, 9).orderBy("row_no").collect()
    assert got and all(len(r["inputs"]) == len(r["targets"]) == 4 and r["inputs"][1:] == r["targets"][:-1] and r["inputs"][0] == 9 for r in got)
    docs = {r["id"]: [9, *r["ids"]] for r in df.collect()}
    for r in got:
        whole = [*r["inputs"], r["targets"][-1]]
        cuts = [i for i, x in enumerate(whole) if x == 9] + [len(whole)]
        assert all(any(d[: b - a] == whole[a:b] for d in docs.values()) for a, b in zip(cuts, cuts[1:]))


def test_training_rows_keep_the_packing_order_and_their_modifiers(spark):
    # A short document first, then one that is cropped to what is left.
    df = spark.createDataFrame([(0, [1, 2], [[1], [2]]), (1, list(range(10, 20)), [[i] for i in range(10, 20)])], "id long, ids array<int>, m array<array<int>>")
    one = rows.training_rows(df, "id", "ids", 9, 1, 99, rows="m", default=[0]).collect()
    assert [tuple(r)[2:] for r in one] == [([99, 1, 2, 99, 10, 11, 12, 13, 14], [1, 2, 99, 10, 11, 12, 13, 14, 15], [[0], [1], [2], [0], [10], [11], [12], [13], [14]], [[1], [2], [0], [10], [11], [12], [13], [14], [15]])]
    short = spark.createDataFrame([(0, [10, 11], [[1], [2]])], df.schema)
    assert tuple(rows.training_rows(short, "id", "ids", 2, 1, 99, 1, "m", [0]).first()) == (0, 0, [99, 10], [10, 11], [[0], [1]], [[1], [2]])
    with pytest.raises(Exception, match="differ in number"):
        rows.training_rows(spark.createDataFrame([(0, [10, 11], [[1]])], df.schema), "id", "ids", 2, 1, 99, 1, "m", [0]).collect()
    # Repeated and null keys are documents each.
    many = spark.createDataFrame([(5, [1]), (5, [2]), (5, [2]), (None, [3]), (None, None)], "id long, ids array<int>")
    got = rows.training_rows(many, "id", "ids", 8, 1, 9).collect()
    assert len(got) == 1 and sorted([*got[0]["inputs"], got[0]["targets"][-1]]) == [1, 2, 2, 3, 9, 9, 9, 9, 9]


def test_endless_documents_go_on_where_they_stopped(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "d e").mkdir()
    for k in range(2):
        pq.write_table(pa.table({"text": [f"{k}-{i}" for i in range(12)], "x": range(12)}), tmp_path / f"d e/f{k}.parquet", row_group_size=3)
    folder, seen = f"{tmp_path}/d e", []

    def some(batches, rank, world, checkpoint, after=None):
        """Until so many more micro-batches are done."""
        start = len(seen)
        stream = documents.endless(spark, folder, rank, world, 3, after, rows=2)
        query = stream.writeStream.foreachBatch(lambda df, n: seen.append((n, sorted(map(tuple, df.collect()))))).option("checkpointLocation", f"{tmp_path}/{checkpoint}").start()
        for _ in range(600):
            if len(seen) >= start + batches or query.exception():
                break
            time.sleep(0.1)
        query.stop()
        assert query.exception() is None
        return [tuple(r[:3]) + (r[3], list(r[4])) for _, part in seen[start:] for r in part]

    def all_of(rank, world, epochs):
        return [(e, f"f{k}.parquet", g, n, [f"{k}-{i}" for i in range(12)][3 * g + 2 * n : 3 * g + min(3, 2 * n + 2)]) for e in range(1, epochs + 1) for k in range(2) for g in range(rank, 4, world) for n in range(2)]

    first = some(2, 0, 1, "a")
    done = first + some(2, 0, 1, "a")
    numbers = sorted({n for n, _ in seen})
    assert numbers == list(range(len(numbers)))
    once = list(dict.fromkeys((e, f, g, n, tuple(t)) for e, f, g, n, t in done))  # a batch that was stopped comes again
    want = [(e, f, g, n, tuple(t)) for e, f, g, n, t in all_of(0, 1, 9)]
    assert len(once) >= 24 and sorted(once) == sorted(want[: len(once)])
    seen.clear()
    assert some(1, 1, 2, "b", after=(2, "f0.parquet", 1))[:2] == [(2, "f0.parquet", 3, n, t) for _, f, g, n, t in all_of(1, 2, 1) if (f, g) == ("f0.parquet", 3)]
    with pytest.raises(ValueError):
        documents.endless(spark, folder, 9, 10)


def test_written_vocabulary_is_read_back(spark, tmp_path):
    merges = bpe.train([("the cat sat é", 5), ("that hat", 7)], 270)
    sinks.write_vocabulary(spark, merges, f"{tmp_path}/v")
    assert sinks.read_vocabulary(spark, f"{tmp_path}/v") == merges
    assert len(json.loads((tmp_path / "v/vocab.json").read_text())) == 270
    (tmp_path / "w").mkdir()
    (tmp_path / "w/vocab.json").write_text((tmp_path / "v/vocab.json").read_text())
    (tmp_path / "w/merges.txt").write_text("#version: 0.2\nt h\nx y\n")
    with pytest.raises(ValueError):
        sinks.read_vocabulary(spark, f"{tmp_path}/w")


def test_callables_keys_and_checks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, prompt string")
    assert [tuple(r) for r in evaluation.generated(df, "prompt", lambda x: [(t or "") + "!" for t in x]).orderBy("id").collect()] == [(1, "a", "a!"), (2, None, "!")]
    assert evaluation.settings_key({"a": 1, "b": 2}) == evaluation.settings_key({"b": 2, "a": 1}) != evaluation.settings_key({"a": 1})
    for bad in ((300, 200, "baseline"), (300, 301, "baseline"), (300, 260, "isolating")):
        with pytest.raises(ValueError):
            bpe.check_superwords(*bad)
    df.write.parquet(f"{tmp_path}/in")
    stream = documents.documents(spark, f"{tmp_path}/in", df.schema)
    for _ in range(2):
        documents.append_results(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
