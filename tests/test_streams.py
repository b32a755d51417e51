"""Operators on streams of ids and modifier rows, on small rows."""

import pytest
from pyspark.sql import functions as F

from weft.plans import streams


def ints(x):
    return F.array(*map(F.lit, x))


def test_pairs_and_spans(spark):
    one = spark.range(1)
    ids, rows = streams.normalized_pair(ints([5, 6, 7]), None, 2)
    assert tuple(one.select(ids, rows).first()) == ([5, 6, 7], [[0, 0]] * 3)
    a, b = streams.span(ids, rows, F.lit(1), F.lit(5))
    assert tuple(one.select(a, b).first()) == ([6, 7], [[0, 0]] * 2)
    with pytest.raises(Exception, match="differ in number"):
        one.select(streams.normalized_pair(ints([5, 6]), F.array(ints([1, 1])), 2)[1]).collect()


def test_reverse_entries(spark):
    rows = [([7], [0, 1], [3, 4]), ([7], [0, 2], [2, 9]), ([7], [1, 0], [5]), ([], [0, 0], [1])]
    df = spark.createDataFrame(rows, "base_ids array<int>, row array<int>, token_ids array<int>")
    assert sorted((r["row"], r["token_ids"]) for r in streams.reverse_entries(df, (1,)).collect()) == [([0, 0], [2, 9]), ([1, 0], [5])]
    assert streams.reverse_entries(df).count() == 3


def test_bytes_make_characters(spark):
    raw = [bytes([x]) for x in "aé\U0001f30d".encode()] + [b"\xc3"]
    df = spark.createDataFrame([([bytearray(x) for x in raw],), ([],)], "t array<binary>")
    got = [[b"".join(map(bytes, g)) for g in r[0]] for r in df.select(streams.byte_components(F.col("t"))).collect()]
    assert got == [["a".encode(), "é".encode(), "\U0001f30d".encode(), b"\xc3"], []]


def test_synthesis(spark):
    none, no, yes = F.lit(None).cast("string"), F.lit(False), F.lit(True)
    made = lambda base, space, prep, cap, pron, det, post, pre, suf: spark.range(1).select(streams.synthesized(F.lit(base), space, prep, cap, pron, det, no, post, pre, suf)).first()[0]
    assert made("  dog", yes, F.lit("of"), yes, none, F.lit("the"), none, F.lit("("), F.lit(").")) == " (Of the dog)."
    assert made("\n", yes, none, no, none, none, none, none, none) == "\n"
    assert made("", yes, none, no, none, none, none, none, none) == ""
    assert made("years", no, none, no, none, none, F.lit("ago"), none, none) == "years ago"


def test_possessives(spark):
    words = ["dog's", "dogs'", "dog's,", "dog", "it.", "friend’s!"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [tuple(r) for r in df.select(*streams.possessive_stripped(F.col("w"))).collect()]
    assert got == [("'s", None, "dog"), ("s'", None, "dog"), ("'s", ",", "dog"), (None, None, "dog"), (None, ".", "it"), ("’s", "!", "friend")]


def runs_of(texts, most, least, join, of=lambda w: w):
    """(key, place, length, run) of the longest run from each place that occurs `least` times in all texts."""
    streams_ = {k: [of(w) for w in t.split(" ")] for k, t in texts.items()}
    every = [tuple(s[p : p + n]) for s in streams_.values() for n in range(1, most + 1) for p in range(len(s) - n + 1)]
    known = {r for r in every if every.count(r) >= least}
    best = lambda s, p: max((n for n in range(1, most + 1) if p + n <= len(s) and tuple(s[p : p + n]) in known), default=0)
    return {(k, p, n, join.join(s[p : p + n])) for k, s in streams_.items() for p in range(len(s)) if (n := best(s, p))}


TURNS = {0: "a b a b A b c", 1: "", 2: "a b c x a b", 3: "c"}


def turns(spark, folder):
    rows = [(0, k, t) for k, t in TURNS.items()] + [(0, 9, None)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def joined(df):
    """Rows of a join of runs; entries that grow with the corpus must not pass the driver."""
    got = set(map(tuple, df.collect()))
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    return got


def test_entries_of_pairs_are_not_broadcast(spark, tmp_path):
    pair = lambda w: f"{w.lower()}/{int(w != w.lower())}"
    assert joined(streams.reverse_prefix_join(spark, turns(spark, tmp_path))) == runs_of(TURNS, 2, 3, " ", pair)


def test_runs_of_pairs_have_no_greatest_length(spark, tmp_path, monkeypatch):
    """Runs longer than what places are first sorted by, turns in copies, in ranges of a few places; the query stopped at two pairs before."""
    from weft.operators import metrics

    monkeypatch.setattr(metrics, "RANGE", 7)
    long = " ".join(f"w{i % 11}{i // 7}" for i in range(45))
    texts = dict(enumerate([f"x {long}", f"{long} y", f"X {long} z", "p q r s", "p q r S", "p q r s", "p q r s", "p q r s", "u u u u u", "", "", " ", "u v", "u v u"]))
    spark.createDataFrame([(0, k, t) for k, t in texts.items()] + [(7, 7, None), (7, 7, "u v")], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    pair = lambda w: f"{w.lower()}/{int(w != w.lower())}"
    want = runs_of(texts | {7007: "u v"}, 47, 3, " ", pair)
    assert max(n for _, _, n, _ in want) == 45
    assert joined(streams.reverse_prefix_join(spark, str(tmp_path))) == want


def test_entries_of_words_are_not_broadcast(spark, tmp_path):
    from weft.plans import queries

    many = {k + 10 * i: t for k, t in TURNS.items() for i in range(2)}
    rows = [(0, k, t) for k, t in many.items()] + [(0, 99, None)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert joined(queries.longest_prefix_join(spark, str(tmp_path))) == runs_of(many, 3, 5, "_")


def test_every_turn_has_its_characters(spark, tmp_path):
    """Turns without text or with none, of one key, and as long as they come."""
    texts = ["", None, "aé", "aé", "\U0001f30d\n" * 3000]
    spark.createDataFrame([(1, 2, t) for t in texts], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = [(r["n_components"], r["n_tokens"]) for r in streams.character_bytes(spark, str(tmp_path)).collect()]
    key = lambda x: (x[1] is None, x)
    assert sorted(got, key=key) == sorted([(None, None) if t is None else (len(t), len(t.encode())) for t in texts], key=key)


def test_groups_of_bytes_in_any_tokens(spark):
    """Tokens of several bytes, cut inside characters, empty ones, and bytes that are no text."""
    rows = [[b"a\xc3", b"\xa9b", b"c"], [b"\xe2", b"\x82\xac\xe2", b"\x82", b"\xac"], [b"", b"a", b"\xc3", b"", b"\xa9"], [b"a", b"\xff", b"b"], [b"\xa9", b"a"]]
    want = [[[b"a\xc3", b"\xa9b"], [b"c"]], [[b"\xe2", b"\x82\xac\xe2", b"\x82", b"\xac"]], [[b""], [b"a"], [b"\xc3", b"", b"\xa9"]], [[b"a"], [b"\xff"], [b"b"]], [[b"\xa9"], [b"a"]]]
    df = spark.createDataFrame([(i, [bytearray(x) for x in r]) for i, r in enumerate(rows)], "i int, t array<binary>")
    got = {r["i"]: [[bytes(x) for x in g] for g in r["g"]] for r in df.select("i", streams.byte_components(F.col("t")).alias("g")).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_entries_by_a_condition_need_no_join(spark):
    from weft.functions import surfaces
    from weft.plans import metadata

    e = spark.createDataFrame([(["a", "b"],), (["a\nb", "b"],), (["\n", "b"],), ([None, "b"],)], "token_ids array<string>")
    odd = e.select(F.explode("token_ids").alias("id")).where(surfaces.mixes_line_space(F.col("id")))
    got = metadata.reachable(e, surfaces.mixes_line_space)
    assert sorted(map(str, got.collect())) == sorted(map(str, metadata.reachable(e, odd).collect()))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_validation_reads_all_parts_of_its_shard(spark, tmp_path):
    from weft.sources import corpus

    docs = spark.createDataFrame([(i, "é" * i) for i in range(9)], "doc_id long, text string")
    for name in ("documents", "more"):
        docs.repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert tuple(streams.validation_rows(spark, str(tmp_path)).first()) == (1, 9, 36)
    both = [str(tmp_path / f"{name}.parquet") for name in ("more", "documents")]
    assert {(r["file"], r["n"]) for r in corpus.split(spark, both, "train").groupBy("file").agg(F.count("*").alias("n")).collect()} == {("documents.parquet", 9)}
    with pytest.raises(ValueError, match="at least two"):
        corpus.split(spark, both[:1], "train")
