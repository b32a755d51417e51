"""Each operator against a brute-force version, on small tables with nulls, empties, ties, repeats and clashing names."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

from weft.llm import components, ivfpq, language, mixing, packing, pii, quality, scratch, substring_dedup, token_counts
from weft.llm.near_dedup import near_duplicates

W = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, c long, pair long, score double, taken long, size long, phrase long, rank int"


def make(spark, rows):
    """Documents with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, len(t) if t else None, 7, 7, 0.5, 7, 7, 7, 7) for i, t, lang, s in rows], SCHEMA)


def corpus(seed=0):
    rng = random.Random(seed)
    syllables = ["the", "an", "re", "on", "ti", "er", "ou", "st", "ha", "is"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = text(30)
    base = text(120)
    rows = [(i, text(rng.randint(1, 80)), "en", f"s{i % 3}") for i in range(20)]
    rows += [(20 + i, f"{text(20)}\n{shared} {text(5)}", "en", "s0") for i in range(5)]
    for i in range(12):
        w = base.split(" ")
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = word()
        rows.append((30 + i, " ".join(w), "en", "s1"))
    long = text(400).split(" ")
    for i in range(6):  # near copies by shingles of five words as well: three words of 400 changed
        rows.append((70 + i, " ".join(word() if j % 130 == 7 + i else x for j, x in enumerate(long)), "en", "s1"))
    rows += [(50, base, "en", None), (51, base.upper(), None, None), (52, None, "en", "s2"), (53, "", "en", "s2"), (54, " \n\t", None, "s2"), (55, "one", "en", "s2"), (56, "one", "en", "s2")]
    rows += [(57, text(3), "en", "é"), (58, "x " * 5000, "en", "s1"), (59, "é" * 300, "en", "s1"), (None, base, "en", "s1"), (60, text(30_000), "en", "s2"), (3, rows[3][1], "en", "s0")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, corpus()).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, [])


def test_substring_removal(docs, empty):
    got = substring_dedup.without_repeats(docs).collect()
    rows = [(r["doc_id"], W.findall(r["text"] or "")) for r in docs.select("doc_id", "text").collect()]
    first: dict = {}
    for i, w in sorted(r for r in rows if r[0] is not None):
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    expected = []
    for i, w in rows:
        gone = [False] * len(w)
        for j in range(len(w) - 12 if i is not None else 0):
            if first[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        expected.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    assert sum(r["n_removed"] for r in got) > 500
    assert substring_dedup.without_repeats(empty).count() == 0


def test_automata_locate_runs_of_words():
    words = [b"w%d" % i for i in range(30)]
    join = b" ".join
    got = substring_dedup.located([(5, join(words)), (3, join(words[4:20])), (9, b"a a a a")], [join(words[2:9]), b"x " + join(words[10:14]) + b"  " + words[14], b"a a a", b"w1w2 w3 w4 w5", b""], 4)
    assert got == [[(0, 5), (1, 5), (2, 3), (3, 3)], [(1, 3), (2, 3)], [], [], []]
    many = [b"%x" % i for i in range(70_000)]  # more words than one plane of characters
    assert substring_dedup.located([(1, join(many))], [join(many[-5:])], 4) == [[(0, 1), (1, 1)]]


def test_removal_is_what_the_automata_locate(docs, monkeypatch):
    seen = []
    plain = substring_dedup.located
    monkeypatch.setattr(substring_dedup, "located", lambda p, s, w: seen.append(len(p)) or [[] for _ in s])
    run = substring_dedup._locator(3)
    import pyarrow as pa

    left = pa.table({"doc_id": [1], "words": [b"a b c d"]})
    right = pa.table({"doc_id": [2], "h": [0], "at": [5], "words": [b"a b c d"]})
    assert run(left, right).num_rows == 0 and seen == [1]
    monkeypatch.setattr(substring_dedup, "located", plain)
    assert run(left, right).to_pylist() == [{"doc_id": 2, "h": 0, "lo": 5, "hi": 9}]


def jaccard_components(rows, k, lower, percent=80):
    table = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}) if lower else {}
    sets: dict = {}
    for i, t in rows:
        w = W.findall((t or "").translate(table))
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        if i is not None:
            sets.setdefault(i, []).append(s)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}, {i: {len(s) for s in x} for i, x in sets.items()}


@pytest.mark.parametrize(("k", "lower"), [(4, True), (5, False)])
def test_near_duplicates(docs, k, lower):
    got = near_duplicates(docs, shingle=k, lower=lower).collect()
    want, sizes = jaccard_components([tuple(r) for r in docs.select("doc_id", "text").collect()], k, lower)
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["kept"]) == (want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
            assert r["n_shingles"] in sizes[r["doc_id"]]
    assert sum(not r["kept"] for r in got) >= 10


def test_words_of_one_build_differ(spark):
    """Long words that only the order of their letters tells apart, as hashes that sum would not."""
    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    df = make(spark, [(1, " ".join([a] * 14), "en", "s"), (2, " ".join([b] * 14), "en", "s"), (3, " ".join([a, b] * 7), "en", "s"), (4, " ".join([b, a] * 7), "en", "s")])
    assert {r["component_id"] for r in near_duplicates(df).collect()} == {1, 2, 3}
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.without_repeats(df).collect()} == {1: 0, 2: 0, 3: 0, 4: 14}


def test_near_duplicates_of_nothing(empty):
    assert near_duplicates(empty).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 460)] + [(5, None), (7, 7)]
    df = spark.createDataFrame(edges, "x long, y long")
    got = {r["node"]: r["component"] for r in components.components(df, "x", "y", scratch.Scratch(spark, "test")).collect()}
    parent = {i: i for e in edges if None not in e and e[0] != e[1] for i in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in (e for e in edges if None not in e and e[0] != e[1]):
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    assert got == {i: find(i) for i in parent}


def test_quality(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "and", "river", "stone", "walks", "under", "bright"]) for _ in range(80)) + "."
    bad = lambda: " ".join(rng.choice(["BUY!!", "WIN***", "$$$", "CLICK&&", "NOW!!!"]) for _ in range(80))
    rows = [(i, good() if i % 3 else bad(), "en", "s") for i in range(300)] + [(900, None, "en", "s"), (901, "", "en", "s"), (None, bad(), "en", "s")]
    docs = make(spark, rows)
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, 0) for i in range(300)] + [(None, 1, 0), (5, None, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {r["doc_id"] for r in docs.where(quality.held_out(F.col("doc_id"))).collect()} >= set(held)
    assert np.mean([(got[i] >= 0.3) == (i % 3 > 0) for i in held]) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == len(rows)
    # The same scores by plain steps: two compressions of each piece, the three differences, the logistic function.
    for i, t, _, _ in rows[:40] + rows[-3:]:
        raw, sums = (t or "").encode(), []
        for data in (model.good, model.bad):
            c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(data), write_dict_id=False, write_content_size=False)
            sums.append(sum(len(c.compress(raw[k : k + 1024])) for k in range(0, len(raw), 1024)))
        x, y = sums
        n = max(len(raw), 64)
        z = (np.array([(y - x) / max(x + y, 1), (y - x) / n, min(x, y) / n]) - model.mean) / model.spread
        assert abs(got[i] - 1 / (1 + np.exp(-(z @ model.weights[:3] + model.weights[3])))) < 1e-9
    twice = quality.train(docs.union(docs), labels)
    assert (twice.good, twice.bad) == (model.good, model.bad) and np.allclose(twice.weights, model.weights)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 0
    assert quality.train(make(spark, []), labels) is None
    assert {r["score"] for r in quality.scored(docs, None, extra=("source",)).collect()} == {0.5}


def unit(x):
    return x / np.linalg.norm(x)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).tolist(), int(i % 3)) for i in range(240)]
    centre = rng.normal(size=16)
    rows += [(300 + i, (centre + rng.normal(size=16) * 0.08).tolist(), 1) for i in range(60)]
    rows += [(400 + i, rows[0][1], 0) for i in range(5)] + [(410, [2 * x for x in rows[0][1]], 0), (411, rows[0][1], 2)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] + [1.0] * 15, 1), (503, [None] + [1.0] * 15, 1), (504, [float("inf")] * 16, 1), (505, [1.0, 2.0], 1), (520, [1.0, 2.01], 1), (540, [-3.0, 2.0], 1), (506, rows[1][1], None), (None, rows[1][1], 1), (507, [], 1)]
    return spark.createDataFrame([(*r, 1.0, 1) for r in rows], "vec_id long, embedding array<double>, label int, score double, v int")


def usable(rows):
    return [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]


def test_search(spark, vectors):
    got: dict = {}
    for r in ivfpq.search(vectors, vectors.where("vec_id % 20 = 0"), k=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    rows = usable([tuple(r) for r in vectors.select("vec_id", "embedding", "label").collect()])
    hits = total = 0
    for i, v, _ in rows:
        if i % 20 == 0:
            best = sorted(((-float(v @ w), j) for j, w, _ in rows if j != i and len(w) == len(v)))[:20]
            mine = sorted(got.pop(i))
            assert [r for r, _, _ in mine] == list(range(1, len(best) + 1))
            assert [(-s, j) for _, j, s in mine] == sorted((-s, j) for _, j, s in mine)
            hits += len({j for _, j in best} & {j for _, j, _ in mine})
            total += len(best)
    assert not got and hits / total >= 0.9
    few = vectors.where("vec_id < 3")
    assert [(r["query_id"], r["vec_id"]) for r in ivfpq.search(few, few.where("vec_id = 0"), k=20).orderBy("rank").collect()].__len__() == 2
    assert ivfpq.search(vectors.where("false"), vectors.where("false")).count() == 0


def test_search_of_large_and_small_vectors(spark):
    rng = np.random.default_rng(3)
    plain = rng.normal(size=(80, 8))
    for size in (1e20, 1e150, 1e160, 1e-120):
        df = spark.createDataFrame([(i, (x * size).tolist()) for i, x in enumerate(plain)], "vec_id long, embedding array<double>")
        got = ivfpq.search(df, df.where("vec_id % 20 = 0"), k=5).collect()
        assert len(got) == 20
        if size < 1e160:
            want = {(q, j) for q in range(0, 80, 20) for _, j in sorted((-float(plain[q] @ w), j) for j, w in enumerate(plain) if j != q)[:5]}
            assert len({(r["query_id"], r["vec_id"]) for r in got} & want) >= 18


def test_vector_near_duplicates(vectors):
    got = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in ivfpq.near_duplicate_vectors(vectors).collect())
    every = [tuple(r) for r in vectors.select("vec_id", "embedding", "label").collect()]
    rows = [(i, unit(v), lab) for i, v, lab in usable(every) if lab is not None]
    links = {i: set() for i, _, _ in rows}
    for i, v, a in rows:
        links[i] = {j for j, w, b in rows if j != i and a == b and len(v) == len(w) and v @ w >= 0.98}
    seen: dict = {}
    for i in sorted(links):
        if i not in seen:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen[x] = i
                    todo += links[x]
    want = sorted((i is None, i or 0, len(links.get(i, ())), seen.get(i, i), seen.get(i, i) == i) for i, _, _ in every)
    assert got == want and max(w[2] for w in want) > 20
    assert ivfpq.near_duplicate_vectors(vectors.where("false")).count() == 0


def test_vectors_with_one_id_stand_each_for_itself(spark):
    """Repeated ids with other vectors or labels: brute force over rows, not ids."""
    v1, v2 = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    near1 = [1.0, 0.01, 0.0]

    def run(rows):
        got = ivfpq.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
        return sorted(map(tuple, got.select("vec_id", "n_links", "component_id", "kept").collect()))

    # No pair of one label is near.
    assert run([(7, v1, 1), (7, v2, 2), (1, v2, 1), (2, v1, 2)]) == [(1, 0, 1, True), (2, 0, 2, True), (7, 0, 7, True), (7, 0, 7, True)]
    # One of the two rows of 7 is.
    assert run([(7, v1, 1), (7, v2, 1), (1, near1, 1)]) == [(1, 1, 1, True), (7, 0, 7, True), (7, 1, 1, False)]
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8))
    rows = [(int(rng.integers(0, 25)), [float(x) for x in centres[rng.integers(0, 6)] + rng.normal(size=8) * 0.12], int(rng.integers(0, 2))) for _ in range(120)]
    rows += rows[:10]
    u = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    links = [{j for j in range(len(rows)) if j != i and rows[i][2] == rows[j][2] and u[i] @ u[j] >= 0.98} for i in range(len(rows))]
    comp = [r[0] for r in rows]
    for _ in rows:
        comp = [min([comp[i], *(comp[j] for j in links[i])]) for i in range(len(rows))]
    assert run(rows) == sorted((r[0], len(links[i]), comp[i], r[0] == comp[i]) for i, r in enumerate(rows))
    assert max(map(len, links)) > 3


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    got = packing.packed(docs).collect()
    tok = Tokenizer.from_file(packing.default_vocabulary())
    want, lengths = [], []
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        for p, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            want.append((str(r["doc_id"]), p, at, len(own), zlib.crc32(own.tobytes())))
            lengths.append(len(own))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    used: dict = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(used) <= -(-sum(lengths) // 4096) + 1
    assert packing.packed(empty).count() == 0


def test_word_ids_match_the_tokenizer():
    from tokenizers import Tokenizer

    voc = packing.default_vocabulary()
    tok = Tokenizer.from_file(voc)
    rng = random.Random(9)
    letters = "aAzé ÉñŸİıſß'’-.!12٣²\n\t\r\x0b  ́日Σς½×÷<|>\0Å"
    given = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    given += ["a<|endoftext|>b", "<|startoftext|>", "DON'T I'LL", "x\x1cy", "ŉ ǅ"]
    for t in given:
        assert packing.text_ids(t, voc) == np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes(), repr(t)


def test_packing_plan_holds_every_length():
    rng = random.Random(6)
    histogram: dict = {}
    for _ in range(30_000):
        n = min(4096, int(rng.lognormvariate(6, 1)) + 1)
        histogram[n] = histogram.get(n, 0) + 1
    made, share = packing.plan(dict(histogram))
    assert share > 0.6  # placed by the program
    back: dict = {}
    for contents, n in made:
        assert sum(size * k for size, k in contents.items()) <= 4096
        for size, k in contents.items():
            back[size] = back.get(size, 0) + k * n
    assert back == histogram
    assert sum(n for _, n in made) <= -(-sum(s * n for s, n in histogram.items()) // 4096) + 1
    assert share > 0.8


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_packing_meets_the_bound_on_documents(spark, table):
    """As few sequences as the tokens fill, most pieces placed by the program."""
    lengths = [r["length"] for r in packing.packed(spark.read.parquet(f"/root/testdata/{table}/documents.parquet")).select("length", "sequence_id").collect()]
    made, share = packing.plan(dict(Counter(lengths)))
    assert sum(n for _, n in made) == -(-sum(lengths) // 4096) and share > 0.8


def test_packing_plans_of_odd_histograms():
    rng = random.Random(3)
    uniform = dict(Counter(rng.randint(1, 4096) for _ in range(4000)))
    for histogram, most in (({}, 0), ({5: 1}, 1), ({4096: 1000}, 1000), ({2048: 999}, 500), ({3000: 500, 1096: 500, 1097: 20}, 507), ({1: 100_000}, 25), ({1366: 9}, 5), (uniform, 1.05 * sum(s * n for s, n in uniform.items()) / 4096)):
        made, _ = packing.plan(dict(histogram))
        back: Counter = Counter()
        for contents, n in made:
            assert n > 0 and sum(size * k for size, k in contents.items()) <= 4096
            for size, k in contents.items():
                back[size] += k * n
        assert back == Counter(histogram) and sum(n for _, n in made) <= most


def test_quality_brings_bounded_pieces_to_the_driver():
    long = bytes(range(256)) * 40_000
    assert len(quality.spread_pieces(long)) == quality.MOST * quality.PIECE
    assert quality.spread_pieces(long)[: quality.PIECE] == long[: quality.PIECE] and quality.spread_pieces(long)[-quality.PIECE :].rstrip() == long[-(len(long) % quality.PIECE or quality.PIECE) :].rstrip()
    assert quality.spread_pieces(b"short") == b"short" and quality.spread_pieces(b"") == b""


def test_token_counts(docs, empty):
    encoding, sizes = token_counts.encoder(token_counts.default_vocabulary())
    for rule in token_counts.RULES:
        for r in token_counts.counted(docs, rule=rule).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
            text = r["text"] or ""
            ids = encoding.encode_ordinary(text)
            lines = text.split("\n")
            lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
            line = [k for k, x in enumerate(lines) for _ in x]  # of each character
            char = [k for k, c in enumerate(text) for _ in c.encode()]  # of each byte
            want, at = [0] * len(lines), 0
            for i in ids:
                a, at = at, at + int(sizes[i])
                touched = [line[k] for k in range(char[a], char[at - 1] + 1)]
                want[touched[0] if rule == "first" else touched[-1] if rule == "last" else max(set(touched), key=lambda k: (touched.count(k), -k))] += 1
            assert (r["section_tokens"], r["n_tokens"]) == (want, len(ids))
    assert token_counts.counted(empty).count() == 0
    assert token_counts.counted(docs).where("doc_id is null").count() == 1 and token_counts.counted(docs).where("doc_id = 3").count() == 2
    with pytest.raises(ValueError):
        token_counts.counted(docs, rule="none")


def test_token_spans_cover_the_text():
    voc = token_counts.default_vocabulary()
    rng = random.Random(8)
    letters = "aAé '.!1\n\t\r\0\x1c\x85日s\U0001f30d"
    for t in ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(2000)] + ["a" * 1_000_000, "é\n" * 200_000]:
        start, end = token_counts.token_spans(t, voc)
        assert (end > start).all() and (not t or (start[0] == 0 and end[-1] == len(t))) and (start[1:] <= end[:-1]).all() and (start[1:] >= end[:-1] - 1).all()
        assert token_counts.line_starts(t).tolist() == [0] + [i + 1 for i, c in enumerate(t[:-1]) if c == "\n"]


PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in p.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def test_pii_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("a@.1+- ()_%2é9\n0" if rng.random() < 0.5 else "a@.b1") for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(t) == brute_spans(t)


def test_pii(spark, docs, empty):
    rows = [(1, "mail a.b@c.example.org or call +1 (509) 555-6973, 10.0.0.1", "en", "s"), (2, "é 4111 1111 1111 1111 end", "en", "s"), (3, "call (555) 123-4567 now", "en", "s"), (4, None, "en", "s"), (5, "", "en", "s"), (None, "x", "en", "s")]
    df = make(spark, rows)
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    assert (got[1]["n_email"], got[1]["n_phone"], got[1]["n_ip"], got[1]["n_card"]) == (1, 1, 1, 0)
    assert got[2]["spans"] == "card:2:21" and got[2]["base_sha256"] == hashlib.sha256(b"card:2:21").hexdigest()
    assert got[3]["n_phone"] == 0 and got[3]["spans"] == "phone:5:19"
    assert got[4]["spans"] == got[5]["spans"] == "" and got[4]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    masked = {r["doc_id"]: r["text"] for r in pii.mask(df).collect()}
    assert masked[1] == "mail <email> or call <phone>, <ip>" and masked[2] == "é <card> end" and masked[4] is None
    assert pii.find(docs).count() == docs.count() and pii.find(empty).count() == 0 and pii.mask(empty).count() == 0
    more = make(spark, [(1, 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y', "en", "s"), (1, "ssn 123-45-6789, write joe [at] site.com", "en", "s"), (2, "isbn 978-3-16-148410-0 at 2024-01-02", "en", "s")])
    assert sorted((r["doc_id"], r["spans"], r["n_spans"]) for r in pii.find(more).collect()) == [(1, "email:23:40,ssn:4:15", 2), (1, "secret:11:51", 1), (2, "", 0)]
    for r in pii.find(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r["spans"] == pii.written(brute_spans(r["text"] or ""))


def segmentations(segments, j):
    """Every segmentation of the first j tokens, as lists of (start, end, features)."""
    if j == 0:
        return [[]]
    return [x + [(j - 1, j, None)] for x in segmentations(segments, j - 1)] + [x + [(i, j, f)] for i, f in segments[j] for x in segmentations(segments, i)]


def test_pii_field_against_enumeration():
    """Best path, partition function and gradient, over all segmentations and labels of short texts."""
    field = pii.trained()
    for text in ("call 555-123-4567 x", "a b@c.de 12345678 7654321"):
        tokens = pii._TOKEN.findall(text)
        segments = pii._segments(tokens, [False] * len(tokens))
        every = {}
        for one in segmentations(segments, len(tokens)):
            for labels in itertools.product(*[[0] if f is None else range(1, len(pii.LABELS) + 1) for _, _, f in one]):
                value = sum(field.t[a, b] for a, b in zip((0, *labels), labels)) + sum(field.score(f)[y - 1] for (_, _, f), y in zip(one, labels) if y)
                every[tuple((i, j, pii.LABELS[y - 1]) for (i, j, _), y in zip(one, labels) if y)] = value
        best = max(every, key=every.get)
        assert field.best(segments) == list(best) and len(every) > 6
        z = np.logaddexp.reduce(list(every.values()))
        value, rows, grad_t = field.log_likelihood(segments, list(best))
        assert abs(value - (every[best] - z)) < 1e-9
        spans = {(i, j): f for j, s in enumerate(segments) for i, f in s}
        want = {}
        for (i, j), f in spans.items():
            p = [sum(np.exp(v - z) for e, v in every.items() if (i, j, k) in e) for k in pii.LABELS]
            want[tuple(f)] = want.get(tuple(f), 0) + np.array([((i, j, k) in best) - q for k, q in zip(pii.LABELS, p)])
        got = {}
        for f, g in rows:
            got[tuple(f)] = got.get(tuple(f), 0) + g
        assert all(np.allclose(got[f], want[f]) for f in want) and len(got) == len(want)
        h = 1e-5
        for a, b in ((0, 0), (0, 4), (4, 0), (0, 1)):
            field.t[a, b] += h
            up = field.log_likelihood(segments, list(best))[0]
            field.t[a, b] -= h
            assert abs((up - value) / h - grad_t[a, b]) < 1e-3


def test_pii_of_long_texts_is_linear():
    rng = random.Random(2)
    field = pii.trained()
    for text in ("".join(rng.choice("abcdefghij") if rng.random() < 0.98 else "7" for _ in range(1_000_000)), "1a" * 200_000):
        start = time.process_time()
        base, added = pii.all_spans(text, field)
        assert base == [] and time.process_time() - start < 20


def test_language(spark):
    rng = random.Random(3)
    words = {"en": ["the", "with", "thing", "which", "have"], "de": ["und", "schön", "ich", "nicht", "über"], "ru": ["это", "был", "город"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang, "s") for i in range(300) for lang in [["en", "de", "ru"][i % 3]]]
    rows += [(900, None, "en", "s"), (901, "12 !! 3", "en", "s"), (902, "the thing with the thing which have und nicht ich über schön nicht und", None, "s"), (None, "the", "en", "s"), (903, "²", None, "s"), (904, "½ ① Ⅷ", None, "s")]
    docs = make(spark, rows)
    model = language.train(docs)
    assert model.langs == ["de", "en", "ru"]
    assert np.allclose(language.train(docs, per_lang=100_000).scores, model.scores)  # fewer than the bound: all are learnt from
    seen = [(t, lang) for i, t, lang, _ in rows if i is not None and t and lang and zlib.crc32(str(i).encode()) % 5]
    counts = {x: Counter(g for t, lang in seen if lang == x for w in re.findall(r"[^\W\d_]+", t) for g in language.trigrams(w)) for x in model.langs}
    for g in (" un", "the", "это"):
        want = [np.log((counts[x][g] + 0.5) / (sum(counts[x].values()) + 0.5 * (len({k for c in counts.values() for k in c}) + 1))) for x in model.langs]
        assert np.allclose(model.scores[model.grams[g]], want)
    many = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 9, f"l{i // 2:03}", "s") for i in range(600)]
    assert len(language.train(make(spark, many)).langs) > 250
    got = {r["doc_id"]: r for r in language.identified(docs, model, with_spans=True).collect()}
    held = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[0] < 300]
    assert all(got[i]["lang_pred"] == lang for i, _, lang, _ in held)
    assert got[903]["lang_pred"] == got[904]["lang_pred"] == "und"
    # Every label and score as a plain Viterbi path over each word's own scores has them.
    for i, t, _, _ in rows[:60] + [rows[302]]:
        own = [language.Model.rows(model, [[w]])[0][0] for w in t.split()]
        s = np.array([x[:-1] for x in own])
        path = plain_viterbi(s)
        share = [sum(x[-1] for x, p in zip(own, path) if p == k) / sum(x[-1] for x in own) for k in range(3)]
        assert got[i]["lang_pred"] == model.langs[int(np.argmax(share))] and abs(got[i]["score"] - max(share)) < 1e-6
    assert (got[900]["lang_pred"], got[901]["lang_pred"], got[900]["score"]) == ("und", "und", 0.0)
    assert [s["lang"] for s in got[902]["spans"]] == ["en", "de"]
    assert language.identified(docs, language.train(make(spark, []))).where("lang_pred = 'und'").count() == len(rows)


def plain_viterbi(s):
    v, back = s[0].astype(float), []
    for t in range(1, len(s)):
        step = v[:, None] - language.PENALTY * (1 - np.eye(s.shape[1]))
        back.append(step.argmax(0))
        v = step.max(0) + s[t]
    want = [int(v.argmax())]
    for b in reversed(back):
        want.append(int(b[want[-1]]))
    return want[::-1]


def test_language_paths_against_plain_viterbi():
    rng = np.random.default_rng(0)
    scores = [rng.normal(0, 3, (int(rng.integers(1, 25)), 300)).astype(np.float32) for _ in range(80)]
    for s, path in zip(scores, language.paths(scores)):
        assert path.tolist() == plain_viterbi(s)
        one = language.all_one(s)
        assert one is None or set(path.tolist()) == {one}


def test_mixing(spark, docs, empty, tmp_path):
    got = mixing.mixed(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    path = str(tmp_path / "d.parquet")
    pq.write_table(docs.toArrow(), path)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{path}')")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    mine = sorted(((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in got), key=key)
    theirs = sorted(((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in con.sql(mixing.SQL).fetchall()), key=key)
    assert mine == theirs
    assert abs(sum(r["taken"] for r in got) - 1.5 * sum(r["size"] for r in got)) < 8
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mixed(empty).count() == 0
    # Rows without an id are spread over keys, not dealt to one; the mix of the same rows in another order is the same.
    again = mixing.mixed(docs.repartition(7, "text")).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in again), key=key) == mine
    zero = mixing.mixed(make(spark, [(1, None, "en", "a"), (2, "", "en", None)])).collect()
    assert {(r["taken"], r["target"]) for r in zero} == {(0, 0.0)}


def test_mixing_targets_stop_at_twice_the_source(spark):
    rows = [(i, "w " * 10, "en", s) for i, s in enumerate(["a"] * 3 + ["b"] * 50 + ["c"] * 40)]
    got = {r["source"]: (r["source_size"], r["target"]) for r in mixing.mixed(make(spark, rows)).collect()}
    sizes, weights = {"a": 30, "b": 500, "c": 400}, {"a": 5, "b": 2, "c": 1}
    want, free, budget = {}, dict(weights), 1.5 * sum(sizes.values())
    while True:
        share = {s: budget * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in share if share[s] > 2 * sizes[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            budget -= want[s]
            del free[s]
    assert {s: round(t, 6) for s, (_, t) in got.items()} == {s: round(t, 6) for s, t in want.items()}
