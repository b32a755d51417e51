import random

import pytest
from pyspark.sql import functions as F

from weft.operators import sequences
from weft.plans import metadata
from weft.plans.composition import DEFAULT, synthesize


def one(spark, ids, make):
    return spark.createDataFrame([(ids,)], "ids array<int>").select(make(F.col("ids")).alias("x")).first()["x"]


def test_arrays(spark):
    assert one(spark, [1, 2], lambda c: sequences.padded(c, 4, 9)) == [1, 2, 9, 9]
    assert one(spark, [1, 2, 3], lambda c: sequences.padded(c, 2)) == [1, 2]
    assert one(spark, [1, 2, 3], lambda c: sequences.tail(c, 2)) == [2, 3] and one(spark, [1], lambda c: sequences.tail(c, 2)) == [1]
    assert one(spark, [1, 5, 7, 5], lambda c: sequences.before_stop(c, [7, 5])) == [1]
    assert one(spark, [1, 2, 3], lambda c: sequences.shifted(c)[0]) == [1, 2] and one(spark, [1, 2, 3], lambda c: sequences.shifted(c)[1]) == [2, 3]
    assert one(spark, [1, 2, 3], lambda c: sequences.common_prefix(c, F.array(*map(F.lit, (1, 2, 4, 5))))) == 2
    row = [1, 0, 2, 3]
    assert one(spark, row, lambda c: sequences.spread(c, F.lit(3), [0, 2])) == [[1, 0, 2, 0], [0, 0, 0, 0], [0, 0, 0, 3]]
    assert one(spark, row, lambda c: sequences.spread(c, F.lit(1), [0])) == [row]
    assert one(spark, row, lambda c: sequences.spread(c, F.lit(2), [0], "last")) == [[0] * 4, row]


def test_empty_span_is_an_error(spark):
    same = F.array(F.lit(1))
    with pytest.raises(Exception, match="empty continuation"):
        spark.range(1).select(sequences.continuation_span(same, same)[1]).collect()


def test_samples_follow_the_generator(spark):
    df = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 0)], "task string, i long")
    got = {(r["task"], r["i"]): r["shots"] for r in sequences.few_shots(df, "task", "i", 3).collect()}
    for i in range(9):
        others = [x for x in range(9) if x != i]
        assert got["a", i] == random.Random(1234 + i).sample(others, 3)
    assert got["b", 0] == []
    ids = list(range(20))
    random.Random(7).shuffle(ids)
    assert sequences.seeded_shuffle(list(range(20)), 7, 5) == ids[:5]


def test_vocabulary_bases(spark):
    vocabulary = spark.createDataFrame([(0, "dog"), (1, " Dog"), (2, "the dog,"), (3, "DOG"), (4, "("), (5, " ")], "id int, surface string")
    got = {r["base_key"]: (r["first_id"], r["n_variants"]) for r in metadata.bases(vocabulary, "id", "surface").collect()}
    assert got == {"dog": (0, 3), "DOG": (3, 1)}
    assert {r["id"] for r in metadata.survivors(vocabulary, "id", "surface").collect()} == {0, 3, 4, 5}
    words = spark.createDataFrame([(7, "dog"), (8, "cat")], "id int, surface string")
    known = spark.createDataFrame([(" dog",)], "surface string")
    assert [r["token_ids"] for r in metadata.whitespace_bridges(words, known, 32).collect()] == [[32, 8]]
    assert metadata.default_indices(["no_x", "a", "none"]) == [0, 2] and metadata.default_indices(["a"]) == [0]
    assert len(set(metadata.byte_alphabet().values())) == 256


def test_bytes_of_modifiers(spark):
    rng = random.Random(2)
    from weft.plans.composition import SIZES

    rows = [[rng.choice((0, 1)), 0, *(rng.randrange(n) for n in SIZES[2:])] for _ in range(50)] + [list(DEFAULT)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, row array<int>")
    for r in df.select("row", metadata.utf8_delta(F.col("row")).alias("d")).collect():
        assert r["d"] == len(synthesize("x", tuple(r["row"])).encode()) - 1
