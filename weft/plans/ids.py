"""Queries on streams of token ids of a real vocabulary: metadata from its tokens, composition in context, and back."""

from __future__ import annotations

import base64
import functools
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import pretokens
from weft.plans import bpe, composition, contextual, metadata, vocabulary
from weft.plans.queries import table
from weft.sources.shared import Tables, lean, slices, spread

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: The pattern that parts texts before rules apply.
PATTERN = "baseline"
#: Beginnings of the names of values, by group; other groups have names of their own.
STARTS = {"determiners": "det_", "prepositions": "prep_", "prefix_punctuation": "punct_prefix_", "suffix_punctuation": "punct_suffix_"}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file of base64 lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def groups() -> dict:
    """The composition document's part on groups, with names of all values."""
    names = {g: [f"no_{g}", *(STARTS[g] + v for v in values[1:])] if g in STARTS else [f"no_{g}", f"with_{g}" if g == "space_prefix" else f"add_{g}"] for g, values in composition.GROUPS}
    return {"version": 1, "num_modifier_groups": len(names), "modifier_group_sizes": [len(v) for v in names.values()], "default_modifier": [0] * len(names), "group_names": list(names), "group_value_names": names}


def word_entries(spark: SparkSession, merges: bpe.Merges, most: int = 2) -> DataFrame:
    """(token_ids, base_ids, modifier_rows, surface): tokens that are a word in title case, behind a space or both.

    The base is the word in lower case and without the space, as the rules encode it, in at most `most` tokens: its
    first carries the space and the capital.
    """
    word = F.expr(r"try_validate_utf8(cast(token as string))")
    rows = bpe.vocabulary(spark, merges).select("id", word.alias("surface")).where(F.col("surface").rlike(r"^ ?\p{L}\p{Ll}*$"))
    bare = F.ltrim("surface")
    rows = rows.select("id", "surface", F.lower(bare).alias("base"), F.startswith("surface", F.lit(" ")).cast("int").alias("space"), (bare != F.lower(bare)).cast("int").alias("cap"))
    rows = rows.where("(space = 1 or cap = 1) and initcap(base) = ltrim(surface) or (space = 1 and cap = 0)")
    made = bpe.encoded(rows, "id", "base", merges, PATTERN, ("surface", "space", "cap")).where(F.size("ids").between(1, most))
    n = len(composition.GROUPS)
    first = F.concat(F.array("space", "cap"), F.array_repeat(F.lit(0), n - 2))
    return made.select(F.array("id").alias("token_ids"), F.col("ids").alias("base_ids"), F.concat(F.array(first), F.transform(F.slice("ids", 2, most), lambda _: F.array_repeat(F.lit(0), n))).alias("modifier_rows"), "surface")


def rule_encoder(merges: bpe.Merges) -> vocabulary.Encoder:
    """An encoder by merge rules: it adds the ids of a text column, however many they are, and keeps all columns."""

    def encode(df: DataFrame, text: str, out: str) -> DataFrame:
        schema = df.withColumn(out, F.array(F.lit(0).cast("long"))).schema

        def run(batches):
            encoder = bpe.Encoder(merges)
            for b in slices(batches, -1):
                ids = [[i for c in chunks or () for i in encoder[c]] for chunks in b.column(b.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.list_(pa.int64()))], names=schema.names)

        return df.withColumn("_chunks", pretokens(F.col(text), PATTERN)).mapInArrow(run, schema)

    return encode


#: Passes of the metadata in order; a later one overwrites the entries of an earlier one for the same ids.
PASSES = ("single_tokens", "seeded", "space_capital", "affixes", "bridges", "pure_merges", "capital_letters")


def metadata_passes_of(spark: SparkSession, merges: bpe.Merges, most: int = 3) -> DataFrame:
    """(pass, token_ids, base_ids, transforms) of every pass over a vocabulary, under its own encoding.

    Candidates are bases with their variants by space and capitals, of at most `most` ids each. Variants and bases of one
    token come first, then tokens whose base has several, then variants of several. Affix entries name as their base
    what owns the stripped surface. Bridges join a space and a word that have no token together; pure merges put blanks or
    marks together that the encoding leaves apart and that no earlier pass has.
    """
    tables, encode = Tables(spark, "metadata"), rule_encoder(merges)
    surface = F.expr("try_validate_utf8(cast(token as string))")
    v = tables.keep(bpe.vocabulary(spark, merges).select(F.col("id").cast("long").alias("id"), surface.alias("surface")).where("surface is not null"), "tokens")
    found = tables.keep(vocabulary.candidates(v, encode, most=most), "candidates")
    single = vocabulary.single_tokens(found).select(F.array("variant_id").alias("token_ids"), F.array("base_id").alias("base_ids"), "transforms")
    of_several = vocabulary.space_cap_entries(found.where((F.size("variant_ids") == 1) & (F.size("base_ids") > 1)), single)
    rest = vocabulary.space_cap_entries(found.where(F.size("variant_ids") > 1), single)
    owners = found.where((F.size("variant_ids") == 1)).select("variant", F.col("base_key").alias("owner"))
    affixed = vocabulary.affix_entries(v, encode, owners).where(F.size("base_ids") <= most).select("token_ids", "base_ids", "transforms")
    none = F.array().cast("array<string>")
    space = v.where("surface = ' '").select("id").first()
    words = v.where(F.col("surface").rlike(r"^\p{L}+$"))
    bridges = metadata.whitespace_bridges(words, v, -1 if space is None else space[0]).select("token_ids", "base_ids", F.array(F.lit("with_space_prefix")).alias("transforms"))
    letters = vocabulary.capital_aliases(v).select("token_ids", "base_ids", F.array(F.lit("add_base_capitalization")).alias("transforms"))

    def named(names: tuple[str, ...], passes: tuple[DataFrame, ...]) -> DataFrame:
        each = (one.where(F.size("token_ids").between(1, most) & (F.size("base_ids") > 0)).select(F.lit(name).alias("pass"), "token_ids", "base_ids", "transforms") for name, one in zip(names, passes))
        return functools.reduce(DataFrame.union, each)

    earlier = tables.keep(named(PASSES[:5], (single, of_several, rest, affixed, bridges.where("token_ids[0] >= 0"))), "earlier")
    pure = vocabulary.pure_merge_entries(v, encode, earlier).select("token_ids", "base_ids", none.alias("transforms"))
    return tables.keep(earlier.union(named(PASSES[5:], (pure, letters))), "entries")


def merged_passes(entries: DataFrame) -> DataFrame:
    """One entry for each run of ids: of the last pass that has one, the least."""
    order = F.array_position(F.array(*map(F.lit, PASSES)), F.col("pass"))
    best = F.max(F.struct(order.alias("p"), F.hash("base_ids", "transforms").alias("h"), "pass", "base_ids", "transforms"))
    return entries.groupBy("token_ids").agg(best.alias("e")).select("token_ids", "e.pass", "e.base_ids", "e.transforms")


def with_rows(entries: DataFrame) -> DataFrame:
    """(token_ids, base_ids, modifier_rows): transforms as values of the groups; entries that the groups can't say go."""
    words = {g: values[1:] for g, values in composition.GROUPS}
    names = {
        "space_prefix": {"with_space_prefix": 1},
        "base_capitalization": {"add_base_capitalization": 1},
        "determiners": {f"article_{w}": i for i, w in enumerate(words["determiners"], 1)},
        "article_capitalization": {"add_article_capitalization": 1},
        "prepositions": {f"prep_{w}": i for i, w in enumerate(words["prepositions"], 1)},
        "prep_capitalization": {"add_prep_capitalization": 1},
        "prefix_punctuation": {f"prefix_punct_{w}": i for i, w in enumerate(words["prefix_punctuation"], 1)},
        "suffix_punctuation": {f"suffix_punct_{w}": i for i, w in enumerate(words["suffix_punctuation"], 1)},
    }
    known = F.array(*(F.lit(n) for g in names.values() for n in g))
    active = F.filter("transforms", lambda t: ~t.startswith("no_"))
    rows = entries.where(F.size(F.array_except(active, known)) == 0)
    of = [(g, _value(F.create_map(*(F.lit(x) for pair in names[g].items() for x in pair)))) for g, _ in composition.GROUPS]
    n = len(of)
    first = F.array(*(x if g in contextual.FIRST_GROUPS else F.when(F.size("base_ids") == 1, x).otherwise(0) for g, x in of))
    last = F.array(*(F.lit(0) if g in contextual.FIRST_GROUPS else x for g, x in of))
    zeros = F.array_repeat(F.lit(0), n)
    middle = F.transform(F.slice("base_ids", 3, 1 << 20), lambda _: zeros)
    made = F.when(F.size("base_ids") == 1, F.array(first)).otherwise(F.concat(F.array(first), middle, F.array(last)))
    return rows.select("token_ids", "base_ids", made.alias("modifier_rows"))


def _value(values: Column) -> Column:
    """The value that one of the transforms has in a group, else 0."""
    return F.coalesce(F.array_max(F.transform("transforms", lambda t: F.try_element_at(values, t))), F.lit(0))


@query()
def metadata_build(spark, sf_dir):
    """By pass: entries of a 50,000-token vocabulary's metadata, those of several ids, and how many of the words of `documents` start with one."""
    _, merges = shared(spark)
    entries = merged_passes(metadata_passes_of(spark, merges))
    firsts = bpe.encoded(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", merges, PATTERN)
    used = firsts.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("used"))
    e = entries.withColumn("id", F.col("token_ids")[0].cast("int")).join(used, "id", "left")
    return e.groupBy("pass").agg(F.count("*").alias("entries"), F.count_if(F.size("token_ids") > 1).alias("of_several_ids"), F.count_if(F.size("base_ids") > 1).alias("to_several_bases"), F.sum(F.when(F.size("token_ids") == 1, F.coalesce("used", F.lit(0))).otherwise(0)).alias("ids_in_documents"))


_known: dict[tuple[int, str], contextual.Shared] = {}


def shared(spark: SparkSession, path: str | None = None) -> tuple[contextual.Shared, bpe.Merges]:
    """Metadata of a vocabulary's words, its spelled ids and its rules, broadcast once a session."""
    path = path or default_vocabulary()
    key = (id(spark.sparkContext), path)
    if key not in _known:
        merges = bpe.recovered(ranks(path))
        entries = [r.asDict() for r in word_entries(spark, merges).collect()]  # as many as the vocabulary has words
        metadata = contextual.Metadata.read({**groups(), "entries": entries})
        _known[key] = contextual.Shared(spark, metadata, dict(enumerate(bpe.token_bytes(merges))), bpe.Encoder(merges)), merges
    return _known[key]


def _composed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, contextual.Shared]:
    lean(spark)
    own, merges = shared(spark)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    ids = bpe.encoded(docs, "doc_id", "text", merges, PATTERN, ("lang",))
    return contextual.composed_ids(ids.withColumn("raw", F.size("ids")), "doc_id", "ids", own, ("lang", "raw")), own


@query("select doc_id, md5(coalesce(text, '')) as restored from documents")
def id_roundtrip(spark, sf_dir):
    """Every document as ids of a 50,000-token vocabulary, composed in context and restored: the digest of what comes out."""
    made, own = _composed(spark, sf_dir)
    back = contextual.restored_text(made, "doc_id", "base_ids", "rows", own)
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("restored"))


@query("select doc_id, strlen(coalesce(text, ''))::bigint as bytes from documents")
def id_bytes(spark, sf_dir):
    """Bytes of every document, summed over its base ids under their rows."""
    made, own = _composed(spark, sf_dir)
    lengths = contextual.byte_lengths(made, "doc_id", "base_ids", "rows", own)
    return lengths.select("doc_id", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("bytes"))


@query()
def id_composition(spark, sf_dir):
    """By language: ids before and after composition, rows that say something, and how often each group does."""
    made, _ = _composed(spark, sf_dir)
    active = F.size(F.filter("rows", lambda r: F.exists(r, lambda v: v != 0)))

    def uses(g: int):
        return F.sum(F.size(F.filter("rows", lambda r: r[g] != 0))).cast("long")

    sums = [uses(g).alias(name) for g, (name, _) in enumerate(composition.GROUPS)]
    # A text that composition could not give back came out as it was, without any row: only a text without words does.
    plain = F.sum(((active == 0) & (F.col("raw") > 8)).cast("int")).cast("long").alias("left_plain")
    return made.groupBy("lang").agg(F.sum("raw").alias("ids"), F.sum(F.size("base_ids")).alias("bases"), F.sum(active).cast("long").alias("active"), plain, *sums)


def composition_document(spark: SparkSession, path: str | None = None) -> str:
    """The composition document of a vocabulary's words as JSON."""
    merges = bpe.recovered(ranks(path or default_vocabulary()))
    entries = [r.asDict() for r in word_entries(spark, merges).orderBy("token_ids").collect()]
    return json.dumps({**groups(), "entries": entries}, sort_keys=True, ensure_ascii=False)
