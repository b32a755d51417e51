"""Queries over all rows of small tables in several scripts, against plain Python."""

import hashlib
import re
import string

from weft.plans import queries


def squad(x):
    x = "".join(c for c in (x or "").lower() if c not in string.punctuation)
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", x).split())


def test_every_turn_is_normalized(spark, tmp_path):
    texts = ["The  cat.", None, "", "\u201cA caf\u00e9\u201d, the \u00c9cole", "\u0391\u0398\u0397\u039d\u0391\u03a3 an\u3000\u6771\u4eac", "a\u0301 the\u00b2 a\u00bd \u00e0 an_", "\u0130stanbul the\u00a0a", "\u65e5\u672ca the-end"]
    spark.createDataFrame(list(enumerate(texts)), "conv_id long, text string").selectExpr("conv_id", "0 as turn", "text").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: (r["digest"], r["folded"]) for r in queries.squad_normalize(spark, str(tmp_path)).collect()}
    assert got == {i: (hashlib.md5(squad(x).encode()).hexdigest(), x is not None and " ".join(x.split()) == x) for i, x in enumerate(texts)}


WORDS = "\u00c9cole \u00e9cole \u00c9COLE caf\u00e9Noir \u041c\u043e\u0441\u043a\u0432\u0430 \u043c\u043e\u0441\u043a\u0432\u0430 \u043c\u043e\u0441\u043a\u0432\u0430\u041a\u0438\u0435\u0432 \u6771\u4eac X-1 x-1 dog. Dog (Dog 42".split()


def test_every_word_reaches_the_word_queries(spark, tmp_path):
    texts = [(i, w) for i, w in enumerate(WORDS)] + [(99, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda q: q(spark, str(tmp_path)).collect()
    by_base = {}
    for i, w in enumerate(WORDS):
        by_base.setdefault(w.lower(), []).append((i, w))
    assert {r["base"]: (r["word"], r["first_doc"]) for r in run(queries.dedup_first_wins)} == {b: (min(x)[1], min(x)[0]) for b, x in by_base.items()}
    assert {r["base"]: r["word"] for r in run(queries.last_write_wins)} == {b: max(x)[1] for b, x in by_base.items()}
    variants = set()
    for b in by_base:
        for space in ("", " "):
            for state, v in (("none", b), ("first_cap", b[0].upper() + b[1:]), ("all_caps", b.upper())):
                if space + v != b:
                    variants.add((b, space + v, space == " ", state))
    assert {tuple(r) for r in run(queries.space_cap_variants)} == variants
    canonical = {}
    for w in WORDS:
        key = (w if w.isupper() else w.lower()) if w.isalpha() else None
        same = [x for x in WORDS if key is not None and x.isalpha() and (x if x.isupper() else x.lower()) == key]
        canonical[w] = min(same, key=lambda x: (x != key, x)) if same else w
    assert {r["word"]: r["canonical"] for r in run(queries.case_space_equivalence)} == canonical
    split = lambda w: "".join((" " if k and w[k].isupper() and (w[k - 1].islower() or w[k - 1].isupper() and w[k + 1 : k + 2].islower()) else "") + c for k, c in enumerate(w))
    assert {r["word"]: r["parts"] for r in run(queries.camel_case)} == {w: split(w) for w in WORDS}

    def base(w):
        w = w.removeprefix("(").removesuffix(".")
        return w if any(c.isalpha() for c in w) and all(c.isupper() for c in w if c.isalpha()) else w.lower()

    grouped = {}
    for w in set(WORDS):
        grouped.setdefault(base(w), set()).add(" " + w)
    assert {r["base_key"]: (r["first_id"], r["n_variants"]) for r in run(queries.vocab_bases)} == {b: (min(x), len(x)) for b, x in grouped.items()}
    assert {r["id"] for r in run(queries.vocab_survivors)} == {w for w in WORDS if base(w) == w}


def test_padding_keeps_every_element(spark, tmp_path):
    texts = {1: "ab c", 2: " ".join(["xyz"] * 200), 3: "", 4: " ".join(["q"] * 66)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["padded"], r["n"], r["total"]) for r in queries.pad_tail_stop_shift(spark, str(tmp_path)).collect()}
    assert got == {i: (200, len(t.split(" ")), sum(map(len, t.split(" ")))) for i, t in texts.items()}


def test_surfaces_of_one_base_and_modifiers_collide(spark, tmp_path):
    start = "x" * 45
    texts = ["iPhone\nipHone\niphone\nThe Dog.\nthe Dog.\nof the \u00e9TaT\nof the \u00c9taT", f"{start}aBc", f"{start}abC", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["base_key"], r["prep"], r["article"], r["suffix_punct"], r["n"], r["first"]) for r in queries.surface_collisions(spark, str(tmp_path)).collect()}
    # The query also gives the small-letter word a capital at its third and at its fourth letter: ipHone is there already.
    want = {("iphone", None, None, None, 3, "iPhone"), (f"{start}abc", None, None, None, 2, f"{start}aBc")}
    # As a phrase and as the words of its own: the phrases with "of the", the single words without.
    want |= {("\u00e9tat", "of", "the", None, 2, "of the \u00c9taT"), ("\u00e9tat", None, None, None, 2, "\u00c9taT")}
    assert got == want


def test_default_budget_takes_what_a_small_one_cuts(spark, tmp_path, monkeypatch):
    sizes = [12_000] * 120 + [0, 7]
    spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda: {r["doc_id"]: r["n_chars"] for r in queries.char_budget(spark, str(tmp_path)).collect()}
    assert run() == {i: min(n, 10_000) for i, n in enumerate(sizes) if n}
    monkeypatch.setattr(queries, "MAX_CHARS", 25_000)
    assert run() == {0: 10_000, 1: 10_000, 2: 10_000}
