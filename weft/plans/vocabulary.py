"""Passes that decompose a vocabulary: which tokens are variants of which bases, and by which transformations.

A vocabulary is a table (id, surface); `encode` adds the ids of a text column. Entries are (token_ids, base_ids,
transforms); passes are unions in order, of which a later one overwrites an earlier one (metadata.passes).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import affixes, surfaces
from weft.functions.literals import ARTICLES, DEMONSTRATIVES, POSSESSIVE_DETERMINERS, PREPOSITIONS, QUANTIFIERS
from weft.operators import corpus, evaluation
from weft.sources.shared import Tables
from weft.plans.queries import _STATE, LINES, SURFACES, _quoted, _strip_sql, _surfaces, _upper

Encoder = Callable[[DataFrame, str, str], DataFrame]
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Characters that count as punctuation at a token's ends, and endings of contractions.
BOUNDARY_PUNCTUATION = "()[]{}\"'.!?,;:"
CONTRACTIONS = ("n't", "'s", "'ll", "'ve", "'re", "'d", "'m")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def by_vocabulary(vocabulary: DataFrame, otherwise: Callable[[Column], Column]) -> Encoder:
    """An encoder that knows whole tokens by a join, and splits what is none by an expression."""

    def encode(df: DataFrame, text: str, out: str) -> DataFrame:
        known = vocabulary.select(F.col("surface").alias("_s"), F.col("id").alias("_i"))
        return df.join(known, F.col(text) == F.col("_s"), "left").withColumn(out, F.when(F.col("_i").isNotNull(), F.array("_i")).otherwise(otherwise(F.col(text)))).drop("_s", "_i")

    return encode


def candidates(vocabulary: DataFrame, encode: Encoder, special: tuple[str, ...] = (), most: int | None = None, promote: bool = True) -> DataFrame:
    """(base_key, base_ids, base_rank, variant, transforms, variant_ids): every base of the vocabulary with its variants by space and capitals.

    Bases come in the order of their first token. A base's ids are those of the first of base, base after a space, base
    in lower case, that after a space, which the vocabulary has; else those of its encoding. A base of several tokens
    is anchored at a single token if it is one behind a space, capitalized, or both, and transformations are then
    relative to that alias. A variant that an earlier base has already stays with that base.
    """
    plain = vocabulary.where(~F.col("surface").isin(list(special))) if special else vocabulary
    keyed = plain.select("id", affixes.space_cap_base(F.col("surface")).alias("base_key")).where(F.coalesce("base_key", F.lit("")) != "")
    bases = keyed.groupBy("base_key").agg(F.min("id").alias("first_id"))
    key = F.col("base_key")
    names = F.array_distinct(F.array(key, F.concat(F.lit(" "), key), F.lower(key), F.concat(F.lit(" "), F.lower(key))))
    hit = evaluation.first_hit(bases.select("base_key"), "base_key", names, vocabulary, "surface").select("base_key", F.coalesce("hit", "base_key").alias("named"))
    bases = encode(bases.join(hit, "base_key"), "named", "base_ids").drop("named")
    if promote:
        capital = affixes.change_first_letter(key, True)
        aliases = F.array_distinct(F.array(F.concat(F.lit(" "), key), capital, F.concat(F.lit(" "), capital)))
        several = bases.where(F.size("base_ids") > 1).select("base_key")
        alias = evaluation.first_hit(several, "base_key", aliases, vocabulary, "surface").select("base_key", F.col("hit").alias("alias"))
        ids = vocabulary.select(F.col("surface").alias("alias"), F.col("id").alias("alias_id"))
        bases = bases.join(alias.join(ids, "alias"), "base_key", "left").withColumn("base_ids", F.when(F.col("alias_id").isNotNull(), F.array("alias_id")).otherwise(F.col("base_ids"))).drop("alias_id")
    else:
        bases = bases.withColumn("alias", F.lit(None).cast("string"))
    rows = bases.select("*", F.explode(affixes.variants(key)).alias("v")).select("base_key", "first_id", "base_ids", "alias", "v.variant", "v.space", "v.state")
    own_space = F.coalesce(F.startswith("alias", F.lit(" ")), F.lit(False))
    own_state = F.when(F.coalesce(surfaces.first_letter_upper(F.col("alias")), F.lit(False)) & ~surfaces.first_letter_upper(key), "first_cap").otherwise(affixes.capitalization(key))
    rows = rows.withColumn("changes", F.col("state") != own_state).withColumn("transforms", surfaces.relative_transforms(F.col("space"), F.col("state"), own_space, own_state))
    # Of a surface that several states give alike (one without letters) the state that changes nothing.
    rows = corpus.first_wins(rows.where(surfaces.any_active(F.col("transforms"))), ["variant"], ["first_id", "changes", "state"])
    rows = encode(rows.select("base_key", "base_ids", F.array_max("base_ids").alias("base_rank"), "variant", "transforms"), "variant", "variant_ids")
    return rows if most is None else rows.where((F.size("base_ids") <= most) & (F.size("variant_ids") <= most))


def single_tokens(found: DataFrame) -> DataFrame:
    """(variant_id, base_id, transforms) of variants and bases that are one token each; a token mapped to itself gives way, and of several bases the least stays."""
    one = found.where((F.size("variant_ids") == 1) & (F.size("base_ids") == 1)).select(F.col("variant_ids")[0].alias("variant_id"), F.col("base_ids")[0].alias("base_id"), "transforms").where("variant_id <> base_id")
    return one.groupBy("variant_id").agg(F.min(F.struct("base_id", "transforms")).alias("m")).select("variant_id", "m.base_id", "m.transforms")


def space_cap_entries(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates as entries, but for token sequences that have one already."""
    return found.select(F.col("variant_ids").alias("token_ids"), "base_ids", "transforms").join(existing.select("token_ids"), "token_ids", "left_anti")


def affix_entries(vocabulary: DataFrame, encode: Encoder, owners: DataFrame) -> DataFrame:
    """(token_ids, base_ids, surface, base, transforms) of tokens with any affix; the base is what owns the stripped surface, else that surface itself."""
    kinds = ("space_prefix", "prefix_punct", "prep", "prep_cap", "article", "article_cap", "suffix_punct")
    s = affixes.strip_affixes(vocabulary.select("surface"), "surface")
    s = s.select("surface", F.explode(F.array(F.struct(*kinds, "base"))).alias("s")).select("surface", "s.*")
    s = s.where(F.coalesce("prefix_punct", "suffix_punct", "article", "prep").isNotNull())
    s = s.withColumn("variant", F.when(F.col("space_prefix"), F.concat(F.lit(" "), "base")).otherwise(F.col("base")))
    s = s.join(owners.select("variant", "owner"), "variant", "left").withColumn("base", F.coalesce("owner", "variant"))
    names = surfaces.complete_transforms({k: F.col(k) for k in kinds} | {"capitalization": F.lit("none")})
    s = s.where("base <> ''").select("surface", "base", F.slice(names, 3, 6).alias("transforms"))
    return encode(encode(s, "surface", "token_ids"), "base", "base_ids").select("token_ids", "base_ids", "surface", "base", "transforms")


def pure_merges(vocabulary: DataFrame, split: Callable[[Column], Column]) -> DataFrame:
    """(token_ids, base_ids) of tokens of white space only or of punctuation only that the encoding would otherwise leave in several."""
    return _pure_merges(vocabulary, lambda df, text, out: df.withColumn(out, split(F.col(text))))


def _pure_merges(vocabulary: DataFrame, encode: Encoder) -> DataFrame:
    pure = F.col("surface").rlike(r"^[\p{Z}\s]+$") | F.col("surface").rlike(r"^[^\p{L}\p{N}\p{Z}\s]+$")
    return encode(vocabulary.where(pure), "surface", "token_ids").where(F.size("token_ids") > 1).select("token_ids", F.array("id").alias("base_ids"))


def pure_merge_entries(vocabulary: DataFrame, encode: Encoder, existing: DataFrame) -> DataFrame:
    """Pure merges under an encoding as entries, of the least token each, but for token sequences that have an entry already."""
    merges = _pure_merges(vocabulary, encode).groupBy("token_ids").agg(F.min("base_ids").alias("base_ids"))
    return merges.join(existing.select("token_ids"), "token_ids", "left_anti")


def capital_aliases(vocabulary: DataFrame) -> DataFrame:
    """(token_ids, base_ids) of tokens whose only letter is a capital, as the token with that letter small."""
    only = F.length(surfaces.letters(F.col("surface"))) == 1
    low = affixes.change_first_letter(F.col("surface"), False)
    rows = vocabulary.where(only & surfaces.first_letter_upper(F.col("surface"))).select("id", low.alias("low"))
    base = vocabulary.select(F.col("surface").alias("low"), F.col("id").alias("base_id"))
    return rows.join(base, "low").select(F.array("id").alias("token_ids"), F.array("base_id").alias("base_ids"))


def literal_ids(vocabulary: DataFrame, literals: list[tuple[str, str]]) -> DataFrame:
    """(group, literal, id, spaced, capital) of the tokens that are a literal of a group, plain or behind a space, as it is or capitalized."""
    spark = vocabulary.sparkSession
    rows = spark.createDataFrame(literals, "group string, literal string")
    forms = F.array(*(F.struct(F.concat(F.lit(" " if spaced else ""), text).alias("surface"), F.lit(spaced).alias("spaced"), F.lit(capital).alias("capital")) for spaced in (False, True) for capital, text in ((False, F.col("literal")), (True, F.initcap("literal")))))
    each = rows.select("group", "literal", F.explode(forms).alias("f")).select("group", "literal", "f.*").groupBy("group", "literal", "surface", "spaced").agg(F.min("capital").alias("capital"))
    return each.join(vocabulary, "surface").select("group", "literal", "id", "spaced", "capital")


def ranks_to_variants(found: DataFrame) -> DataFrame:
    """(base_rank, variants): the variants of each base's highest id, sorted."""
    return found.groupBy("base_rank").agg(F.sort_array(F.collect_set("variant")).alias("variants"))


def has_spaced_words(vocabulary: DataFrame, first: int = 50_000) -> bool:
    """Whether one of the first tokens is a word behind a space."""
    return not vocabulary.orderBy("id").limit(first).where(F.startswith("surface", F.lit(" ")) & F.col("surface").rlike(r"^ +.*[\p{L}\p{N}]")).isEmpty()


def closed(first: DataFrame, second: DataFrame) -> DataFrame:
    """The survivors of a second pass over the survivors of a first one; another number of them is an error."""
    a, b = first.count(), second.count()
    if a != b:
        raise ValueError(f"{b} survivors of {a}")
    return second


def boundary_punctuation(token: Column) -> Column:
    """Whether a token has punctuation at an end and other characters besides, and is no contraction."""
    apostrophe = F.locate("'", token)
    contraction = ((apostrophe > 1) & (apostrophe < F.length(token))) | ((apostrophe > 0) & (F.coalesce(*(F.when(F.endswith(token, F.lit(c)), True) for c in CONTRACTIONS), F.lit(False))))
    bare = F.ltrim(token)
    mark = lambda c: F.contains(F.lit(BOUNDARY_PUNCTUATION), c)
    other = F.length(F.translate(bare, BOUNDARY_PUNCTUATION + " ", "")) > 0
    return (F.length(token) > 1) & ~contraction & (F.length(bare) > 1) & other & (mark(F.substring(bare, 1, 1)) | mark(F.substring(bare, -1, 1)))


def label_ranges(groups: dict[str, list[str]], used: set[str]) -> list[tuple[str, int, int, int]]:
    """(group, place, start, end) of the groups that have a value in use, end to end; the rest go."""
    out, at = [], 0
    for name, values in groups.items():
        if used.intersection(values[1:]):
            out.append((name, len(out), at, at + len(values)))
            at += len(values)
    return out


#: Groups that only English texts have.
ENGLISH_GROUPS = ("determiners", "article_capitalization", "prepositions", "prep_capitalization")


def groups_for(language: str, groups: dict[str, list[str]]) -> dict[str, list[str]]:
    """Without the groups of English function words for another language."""
    return groups if language == "en" else {k: v for k, v in groups.items() if k not in ENGLISH_GROUPS}


# --- queries over the words of the corpus -------------------------------------------------------------------------

VOCABULARY = f"""{SURFACES}, v0 as (select word as surface from surfaces where n >= 2 union select ' ' || word from surfaces where n >= 4 union select x from unnest([' ', '  ', '...', 'A', 'I', 'a', 'i', ' the', 'The', ' The', '"']) u(x)),
vocabulary as (select surface, row_number() over (order by surface) - 1 as id from v0)"""


def _encoded(x: str, alias: str) -> str:
    return f"case when {alias}.id is not null then [{alias}.id] else [-1::bigint, -length({x})] end"


def _tokens(spark, sf_dir) -> DataFrame:
    """The vocabulary of the corpus's frequent words, written once: every pass starts there."""
    s = _surfaces(spark, sf_dir)
    more = spark.createDataFrame([(x,) for x in (" ", "  ", "...", "A", "I", "a", "i", " the", "The", " The", '"')], "surface string")
    words = s.where("n >= 2").select(F.col("word").alias("surface")).union(s.where("n >= 4").select(F.concat(F.lit(" "), "word"))).union(more).distinct()
    ranked = corpus.renumbered(words, "surface", "id").select("surface", F.col("id").cast("long").alias("id"))
    return Tables(spark, "vocabulary").keep(ranked, "tokens")


def _halves(text: Column) -> Column:
    return F.array(F.lit(-1).cast("long"), -F.length(text).cast("long"))


_CANDIDATES = f"""{VOCABULARY}, k0 as (select id, ltrim(surface, ' ') as b from vocabulary where ltrim(surface, ' ') <> '' and surface not in ('The', 'A')),
keyed as (select id, case when regexp_matches(b, '\\p{{L}}') and not regexp_matches(b, '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]') then b else lower(b) end as base_key from k0),
bases as (select base_key, min(id) as first_id from keyed group by base_key),
named as (select b.*, coalesce(v1.id, v2.id, v3.id, v4.id) as one from bases b left join vocabulary v1 on v1.surface = base_key left join vocabulary v2 on v2.surface = ' ' || base_key
 left join vocabulary v3 on v3.surface = lower(base_key) left join vocabulary v4 on v4.surface = ' ' || lower(base_key)),
based as (select base_key, first_id, case when one is not null then [one] else [-1::bigint, -length(base_key)] end as base_ids from named),
capped as (select *, length(regexp_extract(base_key, '^[^\\p{{L}}]*')) + 1 as i from based), alias0 as (select *, base_key[:i - 1] || {_upper('base_key[i]')} || base_key[i + 1:] as cap from capped),
aliased as (select a.*, case when len(base_ids) > 1 then case when s.id is not null then ' ' || base_key when c.id is not null then cap when t.id is not null then ' ' || cap end end as alias, coalesce(s.id, c.id, t.id) as alias_id
 from alias0 a left join vocabulary s on s.surface = ' ' || base_key left join vocabulary c on c.surface = cap left join vocabulary t on t.surface = ' ' || cap),
states as (select base_key, first_id, case when alias is not null then [alias_id] else base_ids end as base_ids, coalesce(starts_with(alias, ' '), false) as own_space,
 case when alias is not null and regexp_matches(regexp_replace(alias, '[^\\p{{L}}]', '', 'g')[1], '\\p{{Lu}}') and not regexp_matches(regexp_replace(base_key, '[^\\p{{L}}]', '', 'g')[1], '\\p{{Lu}}') then 'first_cap' else {{state}} end as own from aliased),
spread as (select base_key, first_id, base_ids, own, own_space, space, state, case when space then ' ' else '' end || case state when 'none' then lower(base_key) when 'first_cap' then {_upper('base_key[1]')} || lower(base_key[2:]) else {_upper('base_key')} end as variant
 from states, (values (false), (true)) s(space), (values ('none'), ('first_cap'), ('all_caps')) c(state)),
named_t as (select *, [case when space = own_space then 'no_space_prefix' when space then 'with_space_prefix' else 'remove_space_prefix' end, case when state = own then 'no_base_capitalization' when state = 'none' then 'remove_base_capitalization' when state = 'all_caps' then 'add_all_caps_base_capitalization' else 'add_base_capitalization' end] as transforms from spread where variant <> base_key),
active as (select * from named_t where space <> own_space or state <> own),
firsts as (select *, row_number() over (partition by variant order by first_id, state <> own, state) as r from active),
found as (select base_key, base_ids, list_max(base_ids) as base_rank, variant, transforms, {_encoded('variant', 'v')} as variant_ids from firsts left join vocabulary v on v.surface = variant where r = 1)"""


def _candidate_sql() -> str:
    return _CANDIDATES.replace("{state}", _STATE.replace("base)", "base_key)").replace("(base,", "(base_key,"))


#: Tokens that the queries set apart as special ones.
SPECIAL = ("The", "A")


def _found(spark, sf_dir):
    v = _tokens(spark, sf_dir)
    return candidates(v, by_vocabulary(v, _halves), SPECIAL)


@query(f"with {_candidate_sql()} select base_key, base_ids, base_rank, variant, array_to_string(transforms, '|') as transforms, variant_ids from found")
def vocab_candidates(spark, sf_dir):
    """Bases of the corpus's frequent words with their variants by space and capitals, as ids."""
    return _found(spark, sf_dir).withColumn("transforms", F.array_join("transforms", "|"))


@query(f"""with {_candidate_sql()}, o as (select variant_ids[1] as variant_id, base_ids[1] as base_id, transforms from found where len(variant_ids) = 1 and len(base_ids) = 1 and variant_ids[1] <> base_ids[1])
select variant_id, min(base_id) as base_id, array_to_string(arg_min(transforms, (base_id, transforms)), '|') as transforms from o group by variant_id""")
def single_token_map(spark, sf_dir):
    """Tokens that are variants of another token, with it and what changes it."""
    return single_tokens(_found(spark, sf_dir)).withColumn("transforms", F.array_join("transforms", "|"))


@query(f"""with {_candidate_sql()}, e as (select [id] as token_ids from vocabulary where id % 3 = 0)
select f.variant_ids as token_ids, f.base_ids, array_to_string(f.transforms, '|') as transforms from found f anti join e on f.variant_ids = e.token_ids""")
def space_cap_pass(spark, sf_dir):
    """Candidates as entries, but for tokens that an earlier pass has (every third)."""
    v = _tokens(spark, sf_dir)
    existing = v.where("id % 3 = 0").select(F.array("id").alias("token_ids"))
    return space_cap_entries(candidates(v, by_vocabulary(v, _halves), SPECIAL), existing).withColumn("transforms", F.array_join("transforms", "|"))


@query(f"with {_candidate_sql()} select base_rank, count(distinct variant) as n, md5(string_agg(distinct variant, '|' order by variant)) as variants from found group by base_rank")
def rank_variants(spark, sf_dir):
    """How many variants each base rank has, and which."""
    r = ranks_to_variants(_found(spark, sf_dir))
    return r.select("base_rank", F.size("variants").cast("long").alias("n"), F.md5(F.array_join("variants", "|").cast("binary")).alias("variants"))


def _affix_sql() -> str:
    stripped = _strip_sql().replace(LINES, f"{VOCABULARY}, lines as (select surface as line from vocabulary)").replace("md5(line) as line", "line")
    names = """[coalesce('article_' || article, 'no_article'), case when article_cap then 'add_article_capitalization' else 'no_article_capitalization' end, coalesce('prep_' || prep, 'no_preposition'),
case when prep_cap then 'add_prep_capitalization' else 'no_prep_capitalization' end, coalesce('prefix_punct_' || prefix_punct, 'no_prefix_punctuation'), coalesce('suffix_punct_' || suffix_punct, 'no_suffix_punctuation')]"""
    return f"""with {VOCABULARY}, s as ({stripped}), b as (select line, case when space_prefix then ' ' || base else base end as variant, {names} as t from s where coalesce(prefix_punct, suffix_punct, article, prep) is not null),
o as (select surface as variant, lower(surface) as owner from vocabulary where surface <> lower(surface)), j as (select line as surface, coalesce(owner, variant) as base, t from b left join o using (variant) where variant <> '')
select j.surface, base, array_to_string(t, '|') as transforms, {_encoded('j.surface', 'v')} as token_ids, {_encoded('base', 'w')} as base_ids from j left join vocabulary v on v.surface = j.surface left join vocabulary w on w.surface = base"""


@query(_affix_sql())
def affix_pass(spark, sf_dir):
    """Tokens with affixes as entries of what owns their stripped surface (here its form in lower case)."""
    v = _tokens(spark, sf_dir)
    owners = v.select(F.col("surface").alias("variant"), F.lower("surface").alias("owner")).where("variant <> owner")
    return affix_entries(v, by_vocabulary(v, _halves), owners).withColumn("transforms", F.array_join("transforms", "|"))


@query(f"""with {VOCABULARY} select [-1::bigint, -length(surface)] as token_ids, [id] as base_ids from vocabulary where (regexp_full_match(surface, '[\\p{{Z}}\\s]+') or regexp_full_match(surface, '[^\\p{{L}}\\p{{N}}\\p{{Z}}\\s]+')) and length(surface) > 1
union all select [a.id], [b.id] from vocabulary a join vocabulary b on b.surface = lower(a.surface) where length(regexp_replace(a.surface, '[^\\p{{L}}]', '', 'g')) = 1 and regexp_matches(a.surface, '\\p{{Lu}}')""")
def merge_and_letter_passes(spark, sf_dir):
    """Tokens of white space or punctuation only, put together again, and capital letters as their small ones."""
    v = _tokens(spark, sf_dir)
    merges = pure_merges(v.where(F.length("surface") > 1), _halves)
    return merges.union(capital_aliases(v))


_LITERALS = [("determiners", x) for x in (*ARTICLES, *POSSESSIVE_DETERMINERS, *DEMONSTRATIVES, *QUANTIFIERS)] + [("prepositions", x) for x in PREPOSITIONS["full"]] + [("suffix_punctuation", x) for x in (".", ",", "!", "?")]


@query(f"""with {VOCABULARY}, l("group", literal) as (values {', '.join(f'({_quoted(g)}, {_quoted(x)})' for g, x in _LITERALS)}),
f as (select "group", literal, p.spaced, c.capital, case when p.spaced then ' ' else '' end || case when c.capital then upper(literal[1]) || literal[2:] else literal end as surface from l, (values (false), (true)) p(spaced), (values (false), (true)) c(capital)),
g as (select "group", literal, surface, spaced, min(capital) as capital from f group by all) select "group", literal, id, spaced, capital from g join vocabulary using (surface)""".replace("group by all", 'group by "group", literal, surface, spaced'))
def literal_tokens(spark, sf_dir):
    """Tokens of the corpus's vocabulary that are function words or punctuation, behind a space or not, capitalized or not."""
    return literal_ids(_tokens(spark, sf_dir), _LITERALS)


@query(f"""with {VOCABULARY}, b as (select surface, ltrim(surface, ' ') as t, instr(surface, '''') as p from vocabulary)
select surface, length(surface) > 1 and length(t) > 1 and not ((p > 1 and p < length(surface)) or (p > 0 and ({' or '.join(f"ends_with(surface, {_quoted(c)})" for c in CONTRACTIONS)})))
 and length(translate(t, {_quoted(BOUNDARY_PUNCTUATION + ' ')}, '')) > 0 and (contains({_quoted(BOUNDARY_PUNCTUATION)}, t[1]) or contains({_quoted(BOUNDARY_PUNCTUATION)}, t[-1])) as pruned from b""")
def boundary_pruned(spark, sf_dir):
    """Tokens that pruning takes away for punctuation at their ends."""
    return _tokens(spark, sf_dir).select("surface", boundary_punctuation(F.col("surface")).alias("pruned"))


@query(f"with {VOCABULARY} select count(*) as n, bool_or(starts_with(surface, ' ') and regexp_matches(surface, '^ +.*[\\p{{L}}\\p{{N}}]')) as spaced from vocabulary")
def vocabulary_facts(spark, sf_dir):
    """Tokens of the corpus's vocabulary, and whether words behind a space are among them."""
    v = _tokens(spark, sf_dir)
    return v.agg(F.count("*").alias("n")).withColumn("spaced", F.lit(has_spaced_words(v)))


@query(f"""with {VOCABULARY}, k as (select id, surface, case when regexp_matches(b, '\\p{{L}}') and not regexp_matches(b, '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]') then b else lower(b) end as base_key from (select *, ltrim(surface, ' ') as b from vocabulary)),
untouched as (select id from k where coalesce(base_key, '') = ''), bases as (select distinct v.id from k join vocabulary v on v.surface = base_key) select id from untouched union select id from bases""")
def survivor_set(spark, sf_dir):
    """Bases in the vocabulary and tokens without one: what a finalized vocabulary keeps; a second pass keeps just them."""
    v = _tokens(spark, sf_dir)
    k = v.withColumn("base_key", affixes.space_cap_base(F.col("surface")))
    keep = lambda t, names: t.where(F.coalesce("base_key", F.lit("")) == "").select("id").union(t.select(F.col("base_key").alias("surface")).distinct().join(names, "surface").select("id")).distinct()
    first = keep(k, v)
    second = keep(k.join(first, "id", "left_semi"), v.join(first, "id", "left_semi"))
    return closed(first, second)
