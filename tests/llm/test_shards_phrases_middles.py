"""Shuffles, collocations and fill-in-middle against brute force, with nulls, empties, ties, repeats and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import collocations, fill_middle, queries, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot long, size long, hash long, word string, id long, form string, output string"


def make(spark, rows):
    """Documents with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, lang, "s", len(t) if t else None, 7, 7, 7, 7, "x", 7, "x", "x") for i, t, lang in rows], SCHEMA)


def odd_texts():
    rng = random.Random(5)
    pieces = ["a", "bc", "é", "日本", "  ", "\n", "\t\x0b", "<P", "<S>", ">", "<", "<M", "\x1c", " ", "😀", "x.y", "<P>"]
    return [None, "", " ", "\n \n", "one", " one", "one ", "<P>", "a <M> b"] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(300)] + ["long é " * 40_000]


# Fill-in-middle


def middle_of(doc_id, text, seed="42"):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (n, "plain", None, None, text)
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_against_brute_force_and_back(spark):
    rows = [(i, t, "en") for i, t in enumerate(odd_texts())] + [(None, "a b c d e f", "en"), (None, None, None), (3, "other text", "en"), (-5, "minus five", "en")]
    out = fill_middle.filled(make(spark, rows))
    got = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda x: (str(x[0]), str(x[-1]))
    want = [(i, *middle_of(i, t), t or "") for i, t, _ in rows]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}


def test_fill_in_middle_parameters_and_empty_table(spark):
    rows = [(i, f"word{i} and some more words", "en") for i in range(50)]
    out = fill_middle.filled(make(spark, rows), percent=100, spm_percent=0, markers=("<|p|>", "<|s|>", "<|m|>"))
    got = out.select("form", "output", fill_middle.restored(F.col("output"), F.col("form"), ("<|p|>", "<|s|>", "<|m|>")).alias("back")).collect()
    assert {r["form"] for r in got} == {"psm"} and all(r["output"].startswith("<|p|>") for r in got)
    assert sorted(r["back"] for r in got) == sorted(t for _, t, _ in rows)
    assert fill_middle.filled(make(spark, rows).limit(0)).collect() == []


def test_ranks_and_selections():
    rng = np.random.default_rng(1)
    for size in (0, 1, 63, 64, 65, 511, 512, 513, 5000):
        for share in (0.0, 0.02, 0.5, 1.0):
            bits = rng.random(size) < share
            v = fill_middle.Bits(bits)
            assert v.rank(np.arange(size + 1)).tolist() == np.concatenate([[0], np.cumsum(bits)]).tolist()
            places = np.flatnonzero(bits)
            assert v.select(np.arange(len(places))).tolist() == places.tolist()


# Shuffles


def checked(got, rows, shards):
    """Shards of equal counts, gapless slots, and every row once."""
    counts = Counter(r["shard"] for r in got)
    each = [counts[s] for s in range(shards)]
    assert sum(each) == len(rows) and max(each) - min(each) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(each[s]))
    key = lambda x: tuple(map(str, x))
    assert sorted(((r["record"]["doc_id"], r["record"]["text"], r["record"]["lang"]) for r in got), key=key) == sorted(rows, key=key)


@pytest.fixture
def small_buckets(monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 16)
    monkeypatch.setattr(sharding, "COPIES", 8)
    monkeypatch.setattr(sharding, "TOGETHER", 4)


def test_shuffle_keeps_every_row_in_equal_shards(spark, small_buckets):
    rows = [(i % 150, t, "en") for i, t in enumerate(odd_texts()[:-1])] + [(None, None, None)] * 200 + [(4, "same", "en")] * 60
    docs = make(spark, rows)
    got = sharding.shuffled(docs, shards=7, seed=1).collect()
    checked(got, rows, 7)
    assert all(r["size"] == len((r["record"]["text"] or "").encode()) + 16 for r in got)
    # Copies of one row are spread over all shards.
    assert {r["shard"] for r in got if r["record"]["doc_id"] is None} == set(range(7))
    place = lambda out: sorted((str(r["record"]), r["shard"], r["slot"]) for r in out)
    again = sharding.shuffled(docs.repartition(9, "source"), shards=7, seed=1).collect()
    assert place(again) == place(got)
    assert place(sharding.shuffled(docs, shards=7, seed=2).collect()) != place(got)


def test_shuffle_of_few_rows_none_and_maps(spark):
    rows = [(i, f"t{i}", "en") for i in range(3)]
    checked(sharding.shuffled(make(spark, rows), shards=40).collect(), rows, 40)
    assert sharding.shuffled(make(spark, rows).limit(0)).collect() == []
    with_map = make(spark, rows).withColumn("a.b", F.create_map(F.lit("k"), F.col("doc_id")))
    got = sharding.shuffled(with_map, shards=2).collect()
    assert sorted(r["record"]["a.b"]["k"] for r in got) == [0, 1, 2]


def test_shuffle_is_uniform(spark, small_buckets):
    """Over many seeds each row comes to each shard about as often: chi-squared over rows and shards."""
    docs = make(spark, [(i, f"t{i}", "en") for i in range(40)]).cache()
    seen = Counter()
    for seed in range(12):
        for r in sharding.shuffled(docs, shards=4, seed=seed).select("record.doc_id", "shard", "slot").collect():
            seen[r["doc_id"] // 10, r["shard"]] += 1
    assert sum(seen.values()) == 480
    assert sum((seen[a, b] - 30) ** 2 / 30 for a in range(4) for b in range(4)) < 27.9  # 0.001 point of 9 degrees


def test_written_shards_are_in_slot_order(spark, tmp_path):
    rows = [(i, f"t{i}", "en") for i in range(100)]
    sharding.write_shards(make(spark, rows), str(tmp_path / "out"), shards=4)
    got = spark.read.parquet(str(tmp_path / "out")).withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id()).collect()
    checked(got, rows, 4)
    by_file = {}
    for r in sorted(got, key=lambda r: r["at"]):
        by_file.setdefault(r["file"], []).append(r["slot"])
    assert all(x == sorted(x) for x in by_file.values())


def test_shard_query_has_the_texts_digest(spark):
    got = queries.op11_two_pass_shuffle(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        assert (r["text_crc32"], r["size"], r["law"], r["grown_shard"]) == (zlib.crc32(texts[r["doc_id"]]), len(texts[r["doc_id"]]) + 16, "rows", None)


# Collocations


def strongest(rows, least, longest, percent, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    held = {x: a for x, a in f.items() if a >= least}
    out = {}
    for (lang, p), a in held.items():
        if len(p) < 2:
            continue
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(o == lang and len(q) > len(p) and inside(q) and 100 * b >= percent * a for (o, q), b in held.items()):
            continue
        score, _, l, r = min((2000000 * a // (f[lang, p[:c]] + f[lang, p[c:]]), c, f[lang, p[:c]], f[lang, p[c:]]) for c in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, all_of in out.items() for i, (s, a, p, l, r) in enumerate(sorted(all_of)[:top]))


def some_phrases(seed):
    rng = random.Random(seed)
    words = ["New", "york", "CITY", "é", "É", "日本", "a-b", "the", "of", "x y"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  "]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None])) for i in range(40)]
    return rows + [(None, None, "en"), (1, "", None), (2, "...", "fr"), (3, "lone", "it")] + [(9, "of the City of New York", "und")] * 20 + [(50, "the " * 3000, "en")]


@pytest.mark.parametrize("seed", range(3))
def test_collocations_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(collocations, "BLOCK", 700)
    monkeypatch.setattr(collocations, "BUCKET", 3000)
    rows = some_phrases(seed)
    got = collocations.collocations(make(spark, rows).repartition(3), least=4, top=25).collect()
    assert sorted(map(tuple, got)) == strongest(rows, 4, 4, 80, 25)


def test_collocations_of_other_lengths_and_of_nothing(spark):
    rows = some_phrases(7)
    assert sorted(map(tuple, collocations.collocations(make(spark, rows), least=3, longest=2, percent=100, top=5).collect())) == strongest(rows, 3, 2, 100, 5)
    assert sorted(map(tuple, collocations.collocations(make(spark, rows), least=3, longest=5, percent=30).collect())) == strongest(rows, 3, 5, 30, 2000)
    assert collocations.collocations(make(spark, rows).limit(0)).collect() == []
    assert collocations.collocations(make(spark, [(1, None, None), (2, "", "en")])).collect() == []


def test_packed_columns_come_back():
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 1000):
        columns = [np.arange(n), rng.integers(-(2**62), 2**62, n), rng.integers(0, 3, n)]
        got, tail = collocations._unpack(collocations._pack(columns, b"a\nb"))
        assert tail == b"a\nb" and all((x == y).all() for x, y in zip(got, columns))
