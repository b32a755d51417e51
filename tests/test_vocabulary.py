"""Vocabulary passes on a few tokens."""

import pytest
from pyspark.sql import functions as F

from weft.plans import vocabulary


@pytest.fixture(scope="module")
def tokens(spark):
    names = ["a", "A", "b", "dog", " dog", " Germany", "The", "the", " ", "  ", "...", "cat.", "US"]
    return spark.createDataFrame(list(enumerate(names)), "id long, surface string")


def split(text):
    return F.array(F.lit(-1).cast("long"), F.length(text).cast("long"))


def test_candidates(tokens):
    got = {(r["base_key"], r["variant"]): (r["base_ids"], r["transforms"]) for r in vocabulary.candidates(tokens, vocabulary.by_vocabulary(tokens, split)).collect()}
    assert got["dog", " dog"] == ([3], ["with_space_prefix", "no_base_capitalization"])
    # Only " Germany" is a token: it is what the base is anchored at, and the plain word takes both away.
    assert got["germany", "Germany"] == ([5], ["remove_space_prefix", "no_base_capitalization"])
    assert got["the", "The"] == ([7], ["no_space_prefix", "add_base_capitalization"])
    assert ("US", "US") not in got and len({v for _, v in got}) == len(got)


def test_single_tokens_and_passes(tokens):
    encode = vocabulary.by_vocabulary(tokens, split)
    found = vocabulary.candidates(tokens, encode)
    assert {(r["variant_id"], r["base_id"]) for r in vocabulary.single_tokens(found).collect()} >= {(4, 3), (6, 7), (1, 0)}
    existing = tokens.where("surface = ' dog'").select(F.array("id").alias("token_ids"))
    assert vocabulary.space_cap_entries(found, existing).where(F.col("token_ids") == F.array(F.lit(4).cast("long"))).isEmpty()
    assert [tuple(r) for r in vocabulary.capital_aliases(tokens).collect()] == [([1], [0])]
    assert {tuple(r["base_ids"]) for r in vocabulary.pure_merges(tokens.where(F.length("surface") > 1), split).collect()} == {(9,), (10,)}
    owners = tokens.sparkSession.createDataFrame([("cat", "kitty")], "variant string, owner string")
    assert sorted((r["surface"], r["base"], r["transforms"][-1]) for r in vocabulary.affix_entries(tokens, encode, owners).collect()) == [("...", "..", "suffix_punct_."), ("cat.", "kitty", "suffix_punct_.")]
    assert vocabulary.has_spaced_words(tokens) and not vocabulary.has_spaced_words(tokens, 3)
    with pytest.raises(ValueError):
        vocabulary.closed(tokens, tokens.limit(2))


def test_pure_merges_leave_earlier_entries(spark):
    """Blanks that the pattern parts: what space and capitals have said of them stays; before, the merge replaced it."""
    from weft.plans import ids

    blank = [(32, 10), (256, 32), (10, 32)]  # " \n", " \n " and "\n "
    entries = ids.metadata_passes_of(spark, blank)
    by_ids = {}
    for r in entries.collect():
        by_ids.setdefault(tuple(r["token_ids"]), []).append((r["pass"], r["base_ids"]))
    assert [p for p, _ in by_ids[256, 32]] == ["space_capital"] and by_ids[10, 32] == [("pure_merges", [258])]
    assert {r["pass"] for r in ids.merged_passes(entries).where("token_ids = array(256L, 32L)").collect()} == {"space_capital"}


def test_groups():
    groups = {"space_prefix": ["no", "with"], "determiners": ["no", "the"], "prepositions": ["no", "of"]}
    assert vocabulary.label_ranges(groups, {"with", "of"}) == [("space_prefix", 0, 0, 2), ("prepositions", 1, 2, 4)]
    assert list(vocabulary.groups_for("de", groups)) == ["space_prefix"] and vocabulary.groups_for("en", groups) == groups
