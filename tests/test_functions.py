import re

import duckdb
import pytest
from pyspark.sql import functions as F

from weft.functions import affixes, scoring, text
from weft.functions.literals import PREPOSITIONS, WORD


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in rows.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


TEXTS = ["The CAT sat on I iPhone", "don't Well-Trained O'Neil", "", "ÄRGER und Ünder", "a-B-c 'Quote'", None]


def test_normalizers_against_python(spark):
    def each(change):
        return [None if t is None else re.sub(WORD, lambda m: change(m[0]), t) for t in TEXTS]

    def titled(w):
        rest = w[1:]
        return w.lower() if w[0].isupper() and rest and not any(c.isupper() for c in rest) and any(c.islower() for c in rest) else w

    assert column(spark, TEXTS, text.lower_first_letters) == each(lambda w: w[0].lower() + w[1:])
    assert column(spark, TEXTS, text.lower_all_letters) == each(str.lower)
    assert column(spark, TEXTS, text.lower_except_all_caps) == each(titled)


@pytest.mark.parametrize(
    ("pattern", "given", "chunks"),
    [
        ("baseline", "I'm", ["I'm"]),
        ("baseline", "don’t", ["don’t"]),
        ("baseline", "use -less", ["use", " -less"]),
        ("baseline", "(word)", ["(", "word", ")"]),
        ("baseline", "word, .word", ["word", ",", " .", "word"]),
        ("isolating", "word, two", ["word", ",", " ", "two"]),
        ("isolating", "12345", ["12", "34", "5"]),
    ],
)
def test_pretokens(spark, pattern, given, chunks):
    assert column(spark, [given], lambda c: text.pretokens(c, pattern)) == [chunks]


def test_patterns_cover_the_text(spark):
    hard = ["a  b\n\n c d", "x y !!\r\n 12", "  lead", "日本語 テスト"]
    for pattern in text.PATTERNS:
        assert column(spark, hard, lambda c: F.array_join(text.pretokens(c, pattern), "")) == hard


def test_affixes(spark):
    df = spark.createDataFrame([(' "(The cat\'s).',), ("On the mat,",), ("of course",), ("",), ("(",)], "line string")
    got = [r.asDict() for r in affixes.strip_affixes(df, "line").collect()]
    assert got[0] | {"line": 0} == {"line": 0, "space_prefix": True, "prefix_punct": '"(', "prep": None, "prep_cap": False, "article": "the", "article_cap": True, "suffix_punct": ").", "base": "cat's"}
    assert (got[1]["prep"], got[1]["prep_cap"], got[1]["article"], got[1]["base"], got[1]["suffix_punct"]) == ("on", True, "the", "mat", ",")
    assert (got[2]["prep"], got[2]["base"]) == ("of", "course")
    assert got[3]["base"] == "" and got[4]["prefix_punct"] == "("
    assert column(spark, ["Their dog", "the", "an apple"], lambda c: affixes.determiner(c, ("the", "their", "a", "an"))) == ["their", None, "an"]
    assert [len(PREPOSITIONS[k]) for k in ("core", "expanded", "full")] == [9, 24, 45]


def test_capitalization(spark):
    words = ["cat", "Cat", "CAT", "A", "cAt", "1", ""]
    assert column(spark, words, affixes.capitalization) == ["none", "first_cap", "all_caps", "first_cap", "all_caps_literal", "none", "none"]
    assert column(spark, [" Cat", "CAT", "  ", "c-T"], affixes.space_cap_base) == ["cat", "CAT", None, "c-t"]
    assert column(spark, [" Cat", "c-T"], affixes.accuracy_surface) == ["cat", None]
    assert column(spark, ["parseHTMLText"], affixes.camel_parts) == [["parse", "HTML", "Text"]]
    assert column(spark, ["1a", "Äb", "1"], lambda c: affixes.change_first_letter(c, True)) == ["1A", "Äb", "1"]


def test_scoring(spark):
    assert column(spark, ["The  cat, a dog!", None], scoring.squad_normalized) == ["cat dog", ""]
    assert column(spark, ["no", "is -1,234.5 or 2"], scoring.first_number) == [None, "-1234.5"]
    assert column(spark, ["\n\n  one two \nthree", " ", "x"], scoring.first_line) == ["one two", "", "x"]
    assert column(spark, ['"Hello," she'], scoring.first_word) == ["Hello"]
    assert column(spark, ["it is #### 1,200"], scoring.final_number) == ["1200"]
    assert column(spark, ["x\n```python\na = 1\n```\ny", " z "], scoring.code_block) == ["a = 1", "z"]
    assert column(spark, ["a\nb. c", "abc"], lambda c: scoring.cut_at_stops(c, [". ", "\n"])) == ["a", "abc"]
    for kind, expected in (("exact", False), ("prefix", True), ("contains", True)):
        assert column(spark, ["paris  france"], lambda c: scoring.em_match(c, F.array(F.lit("paris")), kind)) == [expected]
    rows = [("LAMBADA", "dog. And", "dog"), ("Arithmetic", "= 12", "12"), ("GSM8K", "#### 7", "7"), ("QA", "paris is", "paris"), ("QA", "", "x")]
    df = spark.createDataFrame(rows, "label string, p string, a string")
    assert [r[0] for r in df.select(scoring.task_match(F.col("label"), F.col("p"), F.array("a"))).collect()] == [True, True, True, True, False]
    df = spark.createDataFrame([(20, 0, 10), (20, 20, 10), (10, 1, 1)], "n int, c int, k int")
    assert [round(r[0], 12) for r in df.select(scoring.pass_at_k(F.col("n"), F.col("c"), F.col("k"))).collect()] == [0.0, 1.0, 0.1]


def test_every_query_against_sql(spark):
    """All queries that have SQL, on the smallest tables, as sets of rows."""
    import os

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.sql(f"create view {name.split('.')[0]} as select * from read_parquet('{folder}/{name}')")
    from weft.plans.queries import ORACLE_SQL, QUERIES

    def plain(v):
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, folder)
        order = sorted(df.columns)
        ours = sorted(str([plain(r[c]) for c in order]) for r in df.collect())
        got = con.sql(sql)
        at = [got.columns.index(c) for c in order]
        theirs = sorted(str([plain(r[i]) for i in at]) for r in got.fetchall())
        assert ours == theirs, name
    assert entry.entry(spark).count() > 0
