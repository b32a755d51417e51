"""Many streams at once, part by part, give what one stream after another gives."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_contextual import SCENARIOS, composer
from weft.plans import bpe, contextual, ids


def flat(streams):
    return np.array([i for x in streams for i in x], np.int32), np.array([len(x) for x in streams])


def apart(made, values, sizes, groups):
    ends, rows = np.cumsum(sizes), [tuple(r) for r in values.reshape(-1, groups).tolist()]
    return [(made[a:b].tolist(), rows[a:b]) for a, b in zip(ends - sizes, ends)]


def same(c, streams, at_once=7):
    got, texts, lengths = [], [], []
    for k in range(0, len(streams), at_once):
        made, values, sizes = c.streams.composed(*flat(streams[k : k + at_once]))
        got += apart(made, values, sizes, len(c.meta.groups))
        texts += c.streams.restored(made, values, sizes)
        lengths += c.streams.lengths(made, values).tolist()
    want = [c.compose(x) for x in streams]
    assert got == [(list(a), [tuple(r) for r in b]) for a, b in want]
    assert texts == [c.restore(*x) for x in want]
    assert lengths == [c.length(i, r) for x in want for i, r in zip(*x)]


@pytest.mark.parametrize("name", SCENARIOS)
def test_scenarios_at_once(name):
    spelled, groups, entries, words, stream, _ = SCENARIOS[name]
    c = composer(spelled, groups, entries, words)
    some, r = list(spelled), random.Random(name)
    same(c, [stream, [], stream + stream, stream[::-1], *([r.choice(some) for _ in range(r.randrange(12))] for _ in range(300))])


@pytest.fixture(scope="module")
def english():
    """The whole groups over words in one or several tokens, marks, blanks and bytes."""
    names = ["the", "The", "of", "On", "dog", "Dog", "cat", "ing", "s", "in", "to", "A", "a", "e", "th", "Th", "ir", "their", "x", "house", "é", "7", "ON"]
    texts = [*names, *(" " + x for x in names), " ", "  ", "\n", ".\n", ".", ",", '."', "'", "'s", "’", "(", ' "', ' (', "-", "$$", "  dog", "\t", " \n"]
    spelled = {k: t.encode() for k, t in enumerate(texts)} | {len(texts) + k: b for k, b in enumerate([b"\xc3", b"\xa9", b" \xc3", b"\xe2\x82", b"\xac", b"\xff"])}
    at = {t: i for i, t in enumerate(texts)}
    zero = [0] * 8
    entry = lambda t, base, *on: {"token_ids": [at[t]], "base_ids": [at[x] for x in base], "modifier_rows": [[int(g in on) for g in range(8)], *[zero] * (len(base) - 1)], "surface": t}
    entries = [entry(" dog", ["dog"], 0), entry("Dog", ["dog"], 1), entry(" Dog", ["dog"], 0, 1), entry(" house", ["house"], 0), entry(" their", ["th", "e", "ir"], 0), entry(" Th", ["th"], 0, 1), entry(" cat", ["cat"], 0)]
    words = defaultdict(list, {"dog": [at["dog"]], "cat": [at["cat"]], "th": [at["th"]], "the": [at["the"]], "thing": [at["th"], at["ing"]], "dogs": [at["dog"], at["s"]], '"': [], "\n": [at["\n"]], "thir": [at["th"], at["ir"]], "on": []})
    meta = contextual.Metadata.read({**ids.groups(), "entries": entries})
    return contextual.Composer(meta, spelled, words)


def test_random_streams_at_once(english):
    assert english.streams.cuttable and english.streams.inner >= 0 and english.streams.mark >= 0
    r, some = random.Random(5), list(english.tokens)
    same(english, [[r.choice(some) for _ in range(r.randrange(25))] for _ in range(6000)], 50)


def test_entries_over_words_and_odd_rows_at_once(english):
    texts = {t.text: i for i, t in english.tokens.items() if not t.fragment}
    document = {**ids.groups(), "entries": [
        {"token_ids": [texts["dog"], texts[" cat"]], "base_ids": [texts["dog"], texts["cat"]], "modifier_rows": [[0] * 8, [1] + [0] * 7], "surface": "dog cat"},
        {"token_ids": [texts["."], texts["x"]], "base_ids": [texts["x"]], "modifier": [0] * 8, "surface": ".x"},
        {"token_ids": [texts["th"], texts["ing"]], "base_ids": [texts["house"]], "modifier": [0] * 8, "surface": "house"},
    ]}
    c = contextual.Composer(contextual.Metadata.read(document), {i: t.bytes for i, t in english.tokens.items()}, english.words)
    r, some = random.Random(6), list(c.tokens)
    same(c, [[r.choice(some) for _ in range(r.randrange(25))] for _ in range(3000)], 50)
    with pytest.raises(ValueError):
        contextual._flat(pa.array([[1, 2]]), pa.array([[[0] * 8]]), 8)


def test_recurring_parts_are_composed_once(english, monkeypatch):
    """What a worker does by hand doesn't grow with copies: before, every token of every stream went through the rules."""
    r, some = random.Random(7), list(english.tokens)
    stream = [r.choice(some) for _ in range(200)]
    c, seen = contextual.Composer(english.meta, {i: t.bytes for i, t in english.tokens.items()}, english.words), []
    composed = c.composed
    monkeypatch.setattr(c, "composed", lambda x, a=0, b=None: seen.append((len(x) if b is None else b) - a) or composed(x, a, b))
    same_once = c.streams.composed(*flat([stream] * 50))
    assert sum(seen) <= len(stream) and len(same_once[2]) == 50


def test_forgetting_between_batches(english, monkeypatch):
    monkeypatch.setattr(contextual, "REMEMBERED", 10)
    r, some = random.Random(8), list(english.tokens)
    same(english, [[r.choice(some) for _ in range(20)] for _ in range(200)], 3)


def test_chunks_are_merged_at_once():
    r = random.Random(1)
    merges = [(97, 97), (97, 98), (256, 256), (98, 257), (256, 97), (195, 169), (99, 261), (257, 257)]
    chunks = ["".join(r.choice("aabéc") for _ in range(r.randrange(0, 90))) for _ in range(800)]
    lists = [chunks[k : k + 9] if k % 4 else None for k in range(0, 800, 5)]
    one, many = bpe.Encoder(merges), bpe.Encoder(merges)
    assert many.column(pa.array(lists)).to_pylist() == [[i for x in y or () for i in one.merged(list(x.encode()))] for y in lists]
    assert bpe.Encoder([]).column(pa.array([["ab", ""], [], None])).to_pylist() == [[97, 98], [], []]


def test_null_and_empty_streams(spark, tmp_path):
    spark.createDataFrame([(1, "en", None), (2, "en", ""), (3, "de", "The dog\nof it's é")], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in ids.id_bytes(spark, str(tmp_path)).collect()) == [(1, 0), (2, 0), (3, 18)]
    assert {r["doc_id"] for r in ids.id_roundtrip(spark, str(tmp_path)).where(F.length("restored") == 32).collect()} == {1, 2, 3}
