"""Composition of id streams in context and reconstruction, scenario by scenario, and over streams of random ids."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weft.operators import sequences
from weft.plans import bpe, composition, contextual, ids

NAMES = {
    "space_prefix": ["no_space_prefix", "with_space_prefix"],
    "base_capitalization": ["no_capitalization", "add_capitalization"],
    "article_capitalization": ["no_capitalization", "add_capitalization"],
    "prep_capitalization": ["no_prep_cap", "add_prep_cap"],
}


def composer(spelled, groups, entries=(), words=None):
    """A composer of a few ids: groups by name, with the names of their values where they have literals."""
    values = {g: NAMES.get(g) or [f"no_{g}", *v] for g, v in groups.items()}
    document = {"version": 1, "num_modifier_groups": len(groups), "group_names": list(groups), "group_value_names": values, "entries": list(entries)}
    known = defaultdict(list, words or {})
    return contextual.Composer(contextual.Metadata.read(document), {i: t if isinstance(t, bytes) else t.encode() for i, t in spelled.items()}, known)


SPACE, CAP = {"space_prefix": ()}, {"base_capitalization": ()}
BYTES = {i: bytes([i]) for i in range(256)}


def entry(token_ids, base_ids, row, surface):
    return {"token_ids": token_ids, "base_ids": base_ids, "modifier": row, "surface": surface}


#: Scenario: spelled ids, groups, entries, words, stream, and base ids with rows where they are told.
SCENARIOS = {
    "function words leave the stream": ({1: "The", 2: " ", 3: "cat", 4: "sat", 5: "on", 6: "the", 7: "mat", 8: "."}, {**SPACE, "determiners": ["det_the"], "article_capitalization": (), "prepositions": ["prep_on"], "suffix_punctuation": ["punct_suffix_."]}, (), {}, [1, 2, 3, 2, 4, 2, 5, 2, 6, 2, 7, 8], ([3, 4, 7], [(0, 1, 1, 0, 0), (1, 0, 0, 0, 0), (1, 1, 0, 1, 1)])),
    "a mark alone is literal": ({10: "["}, {"prefix_punctuation": ["punct_prefix_["]}, [entry([10], [10], [1], "[")], {}, [10], ([10], [(0,)])),
    "words that nothing carries": ({1: "for", 2: " ", 3: "your"}, {**SPACE, "determiners": ["det_your"], "prepositions": ["prep_for"]}, (), {}, [1, 2, 3], None),
    "words and a mark that nothing carries": ({1: "for", 2: " ", 3: '"', 4: "your"}, {**SPACE, "determiners": ["det_your"], "prepositions": ["prep_for"], "prefix_punctuation": ['punct_prefix_"']}, (), {}, [1, 2, 3, 4], None),
    "a mark inside function words": ({1: "for", 2: " ", 3: '"', 4: "dog"}, {**SPACE, "prepositions": ["prep_for"], "prefix_punctuation": ['punct_prefix_"']}, (), {}, [1, 2, 3, 4], None),
    "words at the end that nothing carries": ({1: "found", 2: " ", 3: "on", 4: "the"}, {**SPACE, "determiners": ["det_the"], "prepositions": ["prep_on"]}, (), {}, [1, 2, 3, 2, 4], None),
    "no space at the beginning": ({10: "books", 20: "books"}, SPACE, [entry([10], [20], [1], "books")], {}, [10], ([20], [(0,)])),
    "no space after a joiner": ({1: "well", 2: "-", 3: "trained", 11: "well", 13: "trained"}, {**SPACE, "suffix_punctuation": ["punct_suffix_-"]}, [entry([1], [11], [0, 0], "well"), entry([3], [13], [1, 0], "trained")], {}, [1, 2, 3], ([11, 13], [(0, 1), (0, 0)])),
    "no capital after an apostrophe": ({1: "friend", 2: "'", 3: "s", 11: "friend", 13: "s"}, {**SPACE, **CAP, "suffix_punctuation": ["punct_suffix_'"]}, [entry([1], [11], [0, 0, 0], "friend"), entry([3], [13], [1, 1, 0], "s")], {}, [1, 2, 3], ([11, 13], [(0, 0, 1), (0, 0, 0)])),
    "another spelling of a suffix": ({1: "shakespeare", 2: "'S"}, {"suffix_punctuation": ["punct_suffix_'s"]}, (), {}, [1, 2], ([1, 2], [(0,), (0,)])),
    "a space before a dash": ({1: "a", 2: " ", 3: "–", 4: "b"}, SPACE, (), {}, [1, 2, 3, 2, 4], ([1, 2, 3, 4], [(0,), (0,), (0,), (1,)])),
    "two spaces": ({1: "a", 2: " ", 4: "b"}, SPACE, (), {}, [1, 2, 2, 4], ([1, 2, 4], [(0,), (0,), (1,)])),
    "a character of two bytes": (BYTES, {**SPACE, "suffix_punctuation": ["punct_suffix_."]}, (), {}, [32, 195, 169, 46], ([195, 169], [(1, 0), (0, 1)])),
    "bytes of no character": (BYTES, {**SPACE, "suffix_punctuation": ["punct_suffix_."]}, (), {}, [32, 195, 46, 65], None),
    "capitals throughout": ({1: "ON", 2: " ", 3: "switch"}, {**SPACE, "prepositions": ["prep_on"], "prep_capitalization": ()}, (), {}, [1, 2, 3], ([1, 3], [(0, 0, 0), (1, 0, 0)])),
    "after a line feed": ({1: "\n", 2: "For", 3: " ", 4: "example", 5: "for"}, {"prepositions": ["prep_for"], "prep_capitalization": (), **CAP}, (), {"for": [5]}, [1, 2, 3, 4], ([1, 4], [(0, 0, 0), (1, 1, 0)])),
    "mixed case": ({1: "polyA", 11: "polya"}, {**SPACE, **CAP}, [entry([1], [11], [0, 1], "polyA")], {}, [1], ([1], [(0, 0)])),
    "no space over a line feed": ({1: "and", 2: " ", 3: "\n\n", 4: "Dynamic", 14: "dynamic"}, {**SPACE, **CAP}, [entry([4], [14], [0, 1], "Dynamic")], {}, [1, 2, 3, 4], ([1, 2, 3, 14], [(0, 0), (0, 0), (0, 0), (0, 1)])),
    "a space and a word behind a space": ({1: "method.", 2: " ", 3: " On", 4: " similar"}, {**SPACE, "prepositions": ["prep_on"], "prep_capitalization": ()}, (), {}, [1, 2, 3, 4], ([1, 2, 4], [(0, 0, 0), (0, 0, 0), (1, 1, 1)])),
    "a mark apart from its word": ({1: "-", 2: " ", 3: "Scientists", 13: "scientists"}, {**SPACE, **CAP, "prefix_punctuation": ["punct_prefix_-"]}, [entry([3], [13], [0, 1, 0], "Scientists")], {}, [1, 2, 3], ([1, 13], [(0, 0, 0), (1, 1, 0)])),
    "no space between the bases of one token": ({1: "com.github", 11: "com.", 12: "github"}, SPACE, [{"token_ids": [1], "base_ids": [11, 12], "modifier_rows": [[0], [1]], "surface": "com.github"}], {}, [1], ([11, 12], [(0,), (0,)])),
    "two marks in a row": ({1: "name", 2: "'", 3: "]"}, {**SPACE, "suffix_punctuation": ["punct_suffix_'", "punct_suffix_]"]}, (), {}, [1, 2, 3], ([1, 3], [(0, 1), (0, 0)])),
    "a function word in two tokens": ({50: "the", 51: "cat", 70: "T", 71: "he", 72: " "}, {**SPACE, **CAP, "determiners": ["det_the"], "article_capitalization": ()}, [entry([70, 71], [50], [0, 1, 0, 0], "the")], {}, [70, 71, 72, 51], ([51], [(0, 0, 1, 1)])),
    "title case in two tokens": ({80: "S", 81: "earch", 82: "search"}, {**SPACE, **CAP}, (), {"search": [82]}, [80, 81], ([82], [(0, 1)])),
    "title case in two lower-case tokens": ({80: "S", 81: "earch", 82: "sea", 83: "rch", 84: ".", 85: " "}, {**SPACE, **CAP, "suffix_punctuation": ["punct_suffix_."]}, (), {"search": [82, 83]}, [85, 80, 81, 84], ([82, 83], [(1, 1, 0), (0, 0, 1)])),
    "a token behind a space after a preposition": ({5: "on", 7: " mat", 8: " the"}, {**SPACE, "prepositions": ["prep_on"], "determiners": ["det_the"]}, (), {}, [5, 8, 7], ([7], [(0, 1, 1)])),
    "a token behind a space after a line feed": ({1: "\n", 7: " Mat", 17: "mat"}, {**SPACE, **CAP}, [entry([7], [17], [1, 1], " Mat")], {}, [1, 7], ([1, 17], [(0, 0), (1, 1)])),
    "an entry ending inside a word": ({1: "cat", 2: "ch", 11: "CAT"}, {**SPACE, **CAP}, [entry([1], [11], [0, 0], "cat")], {}, [1, 2], ([1, 2], [(0, 0), (0, 0)])),
    "an entry over words apart": ({1: "new", 2: " york", 11: "new york"}, SPACE, [entry([1, 2], [11], [0], "new york")], {}, [1, 2], ([1, 2], [(0,), (1,)])),
    "marks in one token": ({1: "end", 2: '."', 3: '"', 4: "."}, {**SPACE, "suffix_punctuation": ["punct_suffix_."]}, (), {'"': [3]}, [1, 2], ([1, 3], [(0, 1), (0, 0)])),
    "marks in one token after a space": ({1: "end", 2: '."', 3: '"', 4: " "}, {**SPACE, "suffix_punctuation": ["punct_suffix_."]}, (), {'"': [3]}, [1, 4, 2], None),
    "a possessive": ({1: "dog", 2: "'s", 3: " tail", 4: "."}, {**SPACE, "possessives": ["poss_'s", "poss_'"], "suffix_punctuation": ["punct_suffix_."]}, (), {}, [1, 2, 4], ([1], [(0, 1, 1)])),
    "a possessive of several": ({1: "dogs", 2: "'", 3: " tails", 4: "."}, {**SPACE, "possessives": ["poss_'s", "poss_'"], "suffix_punctuation": ["punct_suffix_'", "punct_suffix_."]}, (), {}, [1, 2, 3, 4], ([1, 3], [(0, 2, 0), (1, 0, 2)])),
    "an apostrophe with no word after it": ({1: "dogs", 2: "'", 4: "."}, {**SPACE, "possessives": ["poss_'s", "poss_'"], "suffix_punctuation": ["punct_suffix_'", "punct_suffix_."]}, (), {}, [1, 2, 4], ([1, 4], [(0, 0, 1), (0, 0, 0)])),
    "an apostrophe after another letter": ({1: "dog", 2: "'", 3: " tails"}, {**SPACE, "possessives": ["poss_'s", "poss_'"], "suffix_punctuation": ["punct_suffix_'"]}, (), {}, [1, 2, 3], ([1, 3], [(0, 0, 1), (1, 0, 0)])),
    "an apostrophe inside a word": ({1: "s", 2: "'", 3: "il"}, {**SPACE, "possessives": ["poss_'"]}, (), {}, [1, 2, 3], ([1, 2, 3], [(0, 0), (0, 0), (0, 0)])),
    "a postposition": ({1: "two", 2: " ", 3: "years", 4: " ago", 5: "."}, {**SPACE, "postpositions": ["postp_ago"], "suffix_punctuation": ["punct_suffix_."]}, (), {}, [1, 2, 3, 4, 5], ([1, 3], [(0, 0, 0), (1, 1, 1)])),
    "the longest postposition": ({1: "day", 2: " ", 3: "after", 4: " the", 5: "fact", 6: " facts"}, {**SPACE, "postpositions": ["postp_after", "postp_after the fact"]}, (), {}, [1, 2, 3, 4, 2, 5], ([1], [(0, 2)])),
    "a shorter postposition": ({1: "day", 2: " ", 3: "after", 4: " the", 5: "fact", 6: " facts"}, {**SPACE, "postpositions": ["postp_after", "postp_after the fact"]}, (), {}, [1, 2, 3, 4, 6], ([1, 4, 6], [(0, 1), (1, 0), (1, 0)])),
    "a postposition in other letters": ({1: "day", 2: " ", 3: "AGO"}, {**SPACE, "postpositions": ["postp_ago"]}, (), {}, [1, 2, 3], ([1, 3], [(0, 0), (1, 0)])),
    "a postposition after nothing": ({1: " ago"}, {**SPACE, "postpositions": ["postp_ago"]}, (), {}, [1], ([1], [(1, 0)])),
    "no postposition at a function word": ({1: "the", 2: " ", 3: "ago"}, {**SPACE, "determiners": ["det_the"], "postpositions": ["postp_ago"]}, (), {}, [1, 2, 3], None),
    "no postposition after two spaces or a mark": ({1: "day", 2: " ", 3: "ago", 4: ","}, {**SPACE, "postpositions": ["postp_ago"], "suffix_punctuation": ["punct_suffix_,"]}, (), {}, [1, 2, 2, 3, 4, 2, 3], None),
    "a postposition in two tokens after title case": ({1: "Da", 2: "ys", 3: " a", 4: "go", 5: "days"}, {**SPACE, **CAP, "postpositions": ["postp_ago"]}, (), {"days": [5]}, [1, 2, 3, 4], ([5], [(0, 1, 1)])),
    "nothing": ({1: "a"}, SPACE, (), {}, [], ([], [])),
}


@pytest.mark.parametrize("name", SCENARIOS)
def test_scenarios(name):
    spelled, groups, entries, words, stream, told = SCENARIOS[name]
    c = composer(spelled, groups, entries, words)
    got = c.compose(stream)
    assert c.restore(*got) == c.text(stream)
    if told is not None:
        assert got == told


def test_longest_entry_and_default():
    entries = {(1,): ([10], [(1, 0)]), (1, 2): ([12], [(2, 0)])}
    assert composition.longest_matches([3, 1, 2], entries, (0, 0)) == ([3, 12], [(0, 0), (2, 0)])


def test_restoring_without_composing():
    on = {1: "found", 2: " on", 3: " the", 4: " website"}
    assert composer(on, SPACE).restore([1, 2, 3, 4], [(0,)] * 4) == "found on the website"
    assert composer(BYTES, SPACE).restore([195, 169], [(0,), (0,)]) == "é"
    assert composer(BYTES, SPACE).restore([195, 169], [(1,), (0,)]) == " é"
    stop = composer(BYTES, {"suffix_punctuation": ["punct_suffix_."]})
    assert stop.restore([195, 169], [(0,), (1,)]) == "é."
    assert stop.restore([97, 195, 169], [(0,), (0,), (1,)]) == "aé."
    # A character of several tokens goes before a known run that starts with its first.
    c = composer({**BYTES, 999: b"x"}, SPACE, [{"token_ids": [999], "base_ids": [195], "modifier_rows": [[1]], "surface": " �"}])
    assert c.restore([195, 169], [(1,), (0,)]) == " é"
    with pytest.raises(ValueError):
        stop.restore([1, 2], [(0,)])


def test_lengths_in_bytes():
    c = composer(BYTES, {**SPACE, "suffix_punctuation": ["punct_suffix_."]})
    assert [c.length(i, r) for i, r in zip([195, 169, 195, 169], [(1, 0), (0, 0), (0, 0), (0, 1)])] == [2, 1, 1, 2]
    dog = composer({20: " dog"}, {**SPACE, "determiners": ["det_the"], "prepositions": ["prep_on"], "prefix_punctuation": ['punct_prefix_"'], "suffix_punctuation": ["punct_suffix_."]})
    rows = [(0,) * 5, *(tuple(int(g == i) for g in range(5)) for i in range(5)), (1,) * 5]
    assert [dog.length(20, r) for r in rows] == [4, 4, 7, 6, 4, 4, 13]


def test_documents_that_are_no_metadata():
    with pytest.raises(ValueError):
        contextual.Metadata.read({"version": 2, "num_modifier_groups": 1})
    with pytest.raises(ValueError):
        contextual.Metadata.read({"num_modifier_groups": 2, "entries": [entry([1], [2], [0], "x")]})


def test_random_streams_come_back():
    """Any order of words, marks, spaces and bytes, in whatever tokens."""
    spelled = dict(enumerate([" ", "  ", "\n", "\t", " the", "the", "The", "T", "he", " on", "On", "on", "ON", '"', ' "', "(", ".", " .", "'s", "'", "dogs", "dog", " dog", "Dog", " Dog", "DOG", "s", b"\xc3", b"\xa9", b" \xc3", "é", "É", " É", "7", " ", "mat", " ma", "t", " \tx", "ǆ", "ß", "İ"]))
    groups = {**{g: v[1:] for g, v in ids.groups()["group_value_names"].items()}, "postpositions": ["postp_dog", "postp_mat the dog"], "possessives": ["poss_'s", "poss_'"]}
    lower = {"dog": [21], "mat": [35], "é": [30], "the": [5], "on": [11], "t": [37], "ma": [36]}
    entries = [entry([22], [21], [1, *[0] * 9], " dog"), entry([24], [21], [1, 1, *[0] * 8], " Dog"), entry([36, 37], [35], [1, *[0] * 9], " mat"), entry([32], [30], [1, 1, *[0] * 8], " É")]
    c = composer(spelled, groups, entries, lower)
    rng, changed = random.Random(3), 0
    for _ in range(6000):
        stream = [rng.randrange(len(spelled)) for _ in range(rng.randint(1, 12))]
        got = c.composed(stream)  # without the check that would leave a text as it was
        assert c.restore(*got) == c.text(stream)
        changed += got[0] != stream
    assert changed > 3000


def test_sequences_with_rows_are_framed_and_stacked(spark):
    df = spark.createDataFrame([(1, [5, 6], [[1, 0], [0, 2]]), (2, [], []), (3, [7], [[3, 3]])], "id int, ids array<int>, rows array<array<int>>")
    a, b = contextual.framed(F.col("ids"), F.col("rows"), (0, 9), 50, 51)
    framed = df.select("id", a.alias("ids"), b.alias("rows"))
    assert [tuple(r) for r in framed.orderBy("id").collect()][1:] == [(2, [50, 51], [[0, 9], [0, 9]]), (3, [50, 7, 51], [[0, 9], [3, 3], [0, 9]])]
    got = {r["id"]: (r["ids"], r["rows"]) for r in sequences.stacked(df, "ids", 4, "rows", [0, 9]).collect()}
    assert got == {1: ([5, 6], [[1, 0], [0, 2]]), 2: ([4, 4], [[0, 9], [0, 9]]), 3: ([7, 4], [[3, 3], [0, 9]])}
    with pytest.raises(ValueError):
        sequences.stacked(df, "ids", 4, "rows")
    with pytest.raises(Exception, match="as many modifier rows"):
        sequences.stacked(df.withColumn("rows", F.when(F.col("id") > 1, F.col("rows"))), "ids", 4, "rows", [0, 9]).collect()
    assert sequences.stacked(df.limit(0), "ids", 4, "rows", [0, 9]).collect() == []


def test_rules_recovered_from_ranks():
    merges = bpe.train([("the cat sat", 5), ("that hat", 7), ("aaaa", 3)], 275)
    tokens = bpe.token_bytes(merges)
    assert bpe.recovered({t: 1000 + i for i, t in enumerate(tokens)}) == merges
    # Bytes in another order than their values are seeds all the same.
    assert bpe.recovered({t: (255 - i if i < 256 else i) for i, t in enumerate(tokens)}) == merges
    with pytest.raises(ValueError):
        bpe.recovered({t: i for i, t in enumerate(tokens[1:])})
    with pytest.raises(ValueError):
        bpe.recovered({**{bytes([i]): i for i in range(256)}, b"abc": 256})


def test_ids_of_whole_documents(spark):
    folder = "/root/testdata/sf0.001"
    want = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.md5(F.col("text").cast("binary"))).collect()}
    assert dict(map(tuple, ids.id_roundtrip(spark, folder).collect())) == want
    rows = ids.id_composition(spark, folder).collect()
    assert sum(r["bases"] for r in rows) < 0.95 * sum(r["ids"] for r in rows)
    assert all(r[g] > 0 for r in rows for g in ("space_prefix", "base_capitalization", "suffix_punctuation"))
    assert sum(r["determiners"] for r in rows) > 0 and sum(r["prepositions"] for r in rows) > 0


def test_odd_documents_as_ids(spark):
    own, merges = ids.shared(spark)
    texts = [None, "", " ", "\n\n  The  dog ", "é́ ퟿😀 the 😀.", "On the\nOn  the On", "x" * 3000, "The THE tHe the.", "'(the \"dog's\")'"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, rows string")
    made = contextual.composed_ids(bpe.encoded(docs, "doc_id", "text", merges, ids.PATTERN), "doc_id", "ids", own)
    back = {r["doc_id"]: r["text"] for r in contextual.restored_text(made, "doc_id", "base_ids", "rows", own).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert contextual.composed_ids(bpe.encoded(docs.limit(0), "doc_id", "text", merges, ids.PATTERN), "doc_id", "ids", own).collect() == []


def test_metadata_of_all_passes(spark):
    """Entries of the passes over a real vocabulary: several ids and several bases, and composition with them is still exact."""
    _, merges = ids.shared(spark)
    entries = ids.metadata_passes_of(spark, merges)
    merged = ids.merged_passes(entries)
    assert merged.count() == merged.select("token_ids").distinct().count()
    by_pass = {r["pass"]: r["count"] for r in merged.groupBy("pass").count().collect()}
    assert {"single_tokens", "space_capital", "affixes", "bridges", "capital_letters"} <= set(by_pass)
    rows = [r.asDict() for r in ids.with_rows(merged).collect()]
    assert sum(len(r["token_ids"]) > 1 for r in rows) > 10_000 and sum(len(r["base_ids"]) > 1 for r in rows) > 100
    assert all(len(r["base_ids"]) == len(r["modifier_rows"]) for r in rows)
    c = contextual.Composer(contextual.Metadata.read({**ids.groups(), "entries": rows}), dict(enumerate(bpe.token_bytes(merges))), bpe.Encoder(merges))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    raw = bpe.encoded(docs, "doc_id", "text", merges, ids.PATTERN, ("text",)).collect()
    made = [c.compose(r["ids"]) for r in raw]
    assert [c.restore(*m) for m in made] == [r["text"] for r in raw]
    assert sum(len(m[0]) for m in made) < 0.95 * sum(len(r["ids"]) for r in raw)
    # Most entries say of their ids just what these are: composing their own ids gives their text back.
    some = rows[:: len(rows) // 300]
    assert all(c.restore(*c.compose(r["token_ids"])) == c.text(r["token_ids"]) for r in some)
