import random
import zlib

import corpus_pipeline
from weft.llm import packing, pii, quality


def test_stages_one_by_one(spark, tmp_path):
    rng = random.Random(7)
    good = lambda n: " ".join(rng.choice(["the", "and", "river", "stone", "walks", "under", "bright", "cold"]) + str(rng.randrange(40)) for _ in range(n)) + " it ends"
    bad = lambda n: " ".join(rng.choice(["BUY!!", "WIN***", "$$$", "CLICK&&", "NOW!!!"]) for _ in range(n))
    rows = [(i, good(60) if i % 4 else bad(60), "en", f"s{i % 5}" if i % 7 else None) for i in range(160)]
    rows += [(200, rows[1][1], "en", "s1"), (201, rows[1][1] + " more", "en", "s1"), (202, good(50) + " mail a@b.example.com now", "en", "s2"), (203, None, None, None), (204, "", "en", "s1"), (205, good(4000), "en", "s3"), (None, good(40), "en", "s1"), (206, good(30_000), "en", "s2"), (1, rows[1][1], "en", "s1")]
    spark.createDataFrame([(i, t, lang, s, len(t) if t else None, 1, 1) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long, taken long, size int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1 if i % 4 else 0, 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    before, after = seen["quality"]
    model = quality.train(before, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    want = {r["doc_id"] for r in before.collect() if model.score((r["text"] or "").encode()) >= 0.3}
    assert {r["doc_id"] for r in after.collect()} == want and {i for i in range(160) if i % 4} <= want
    assert not {i for i in range(160) if i % 4 == 0} & want
    before, after = seen["near_dedup"]
    ids = {r["doc_id"] for r in after.collect()}
    assert 1 in ids and None in ids and {r["doc_id"] for r in before.collect()} - ids == {200, 201}
    before, after = seen["pii"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        t = texts[r["doc_id"]]
        assert r["text"] == (pii.masked(t, pii.base_spans(t)) if t else t) and r["n_chars"] == (len(r["text"]) if r["text"] is not None else None)
    before, after = seen["mixing"]
    words: dict = {}
    for r in before.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len((r["text"] or "").split())
    taken: dict = {}
    for r in after.collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(r["text"].split())
    assert abs(sum(taken.values()) - 1.5 * sum(words.values())) < 10 and all(n <= 2 * words[i] for i, n in taken.items())
    before, after = seen["packing"]
    voc = packing.default_vocabulary()
    want = sorted((str(r["doc_id"]), zlib.crc32(packing.text_ids(r["text"], voc)[:16384])) for r in before.collect())
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in after.where("piece = 0").collect()) == want
    key = lambda df: sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, str(tmp_path))) == key(after)


def test_stages_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mixing_takes_the_budget_of_rows_without_or_with_repeated_ids(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _mix_row int, size int, taken int"
    four = [(i, f"{a} b c d", "en", "s", 7, 1, 1, 1) for i, a in ((1, "x"), (1, "y"), (None, "x"), (None, "x"), (2, "z"))]
    got = corpus_pipeline.mixing_stage(spark, spark.createDataFrame(four, schema), "").collect()
    assert sum(len(r["text"].split()) for r in got) == 30
    assert all(r["n_chars"] == len(r["text"]) and r["_mix_row"] == 1 for r in got)
    counts: dict = {}
    for r in got:
        counts[r["doc_id"], r["text"][0]] = counts.get((r["doc_id"], r["text"][0]), 0) + len(r["text"].split())
    assert all(n <= (16 if k == (None, "x") else 8) for k, n in counts.items())
