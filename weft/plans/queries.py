"""Registered queries of the tokenizer's data preparation, each over whole tables, with DuckDB SQL where SQL can say it."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import affixes, scoring, text
from weft.functions.literals import APOSTROPHES, ARTICLES, ASCII_PUNCTUATION, POSSESSIVE_DETERMINERS, PREFIX_PUNCTUATION, PREPOSITIONS, WORD
from weft.operators import corpus, metrics, sequences
from weft.plans import bpe, composition, metadata, rows
from weft.sources.shared import Tables, spread

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
DETERMINERS = ARTICLES + POSSESSIVE_DETERMINERS


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _lines(spark, sf_dir) -> DataFrame:
    """Every line of every document, as a distinct surface."""
    return _documents(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("line")).distinct()


def _surfaces(spark, sf_dir) -> DataFrame:
    """Distinct words between blanks, with the least document that has each."""
    words = _documents(spark, sf_dir).select("doc_id", F.explode(F.split("text", "[ \n]+")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


#: Possessives and marks that words are given where a rule on endings is to be seen at work.
ENDINGS = ("'s", "’s", "s'", "s’", "'s.", "s’,", ".'s", "?")
LINES = "lines as (select distinct unnest(string_split(text, chr(10))) as line from documents)"
SURFACES = "surfaces as (select word, min(doc_id) as first_doc, count(*) as n from (select doc_id, unnest(string_split_regex(text, '[ \\n]+')) as word from documents) where word <> '' group by word)"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _case(literals, test: str) -> str:
    return "case " + " ".join(f"when {test.format(q=_quoted(x), s=_quoted(x + ' '))} then {_quoted(x)}" for x in literals) + " end"


def _longest(literals):
    return sorted(literals, key=len, reverse=True)


@query("select lang, count(*) as n_docs, sum(length(text)) as n_chars, sum(strlen(text)) as n_bytes, sum(length(text[:10000])) as n_cropped from documents group by lang")
def corpus_counts(spark, sf_dir):
    """Documents, code points, bytes and cropped code points of each language."""
    return _documents(spark, sf_dir).groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"), F.sum(F.octet_length("text")).alias("n_bytes"), F.sum(F.length(text.crop(F.col("text"), 10_000))).alias("n_cropped")
    )


#: Characters that the tokenizer's training takes by default.
MAX_CHARS = 2_000_000_000


@query(f"""with c as (select doc_id, text[:10000] as text from documents),
s as (select *, coalesce(sum(length(text)) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as upto from c)
select doc_id, length(text) as n_chars from s where upto <= {MAX_CHARS} and length(text) > 0""")
def char_budget(spark, sf_dir):
    """Documents that the default budget of cropped characters takes, in the order of their ids."""
    kept = corpus.within_budget(_documents(spark, sf_dir).select("doc_id", "text"), "doc_id", "text", MAX_CHARS, 10_000)
    return kept.select("doc_id", F.length("text").alias("n_chars"))


_SPLIT = f"string_split_regex(text, '{WORD.replace(chr(39), chr(39) * 2)}') as g, regexp_extract_all(text, '{WORD.replace(chr(39), chr(39) * 2)}') as w"
_LOWER = f"translate({{}}, '{text.UPPER}', '{text.LOWER}')"


def _word_sql(change: str) -> str:
    return f"""with p as (select doc_id, {_SPLIT} from documents)
select doc_id, md5(array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce({change}, '')), '')) as digest from p"""


def _normalized(name):
    def run(spark, sf_dir):
        return _documents(spark, sf_dir).select("doc_id", F.md5(text.PREPROCESSORS[name](F.col("text")).cast("binary")).alias("digest"))

    run.__name__ = f"norm_{name}"
    return run


query(_word_sql(_LOWER.format("w[i][1]") + " || w[i][2:]"))(_normalized("first_letter"))
query(_word_sql(_LOWER.format("w[i]")))(_normalized("all_letters"))
query(_word_sql(f"case when regexp_full_match(w[i], '[A-Z][^A-Z]*[a-z][^A-Z]*') then {_LOWER.format('w[i]')} else w[i] end"))(_normalized("except_all_caps"))

_SPACE = r"\p{Z}\t-\r\x{85}"
_ISOLATING_RE2 = rf"\p{{L}}+(?:{APOSTROPHES}\p{{L}}+)*|\p{{N}}{{1,2}}|[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+".replace("'", "''")


@query(f"""with p as (select doc_id, regexp_extract_all(text, '{_ISOLATING_RE2}') as c from documents)
select doc_id, len(c) as n_chunks, length(array_to_string(c, '')) as n_chars, len(list_distinct(c)) as n_distinct from p""")
def pretok_ws_counts(spark, sf_dir):
    """Pre-tokens of the whitespace-isolating pattern in each document."""
    p = _documents(spark, sf_dir).select("doc_id", text.pretokens(F.col("text")).alias("c"))
    return p.select("doc_id", F.size("c").cast("long").alias("n_chunks"), F.length(F.array_join("c", "")).cast("long").alias("n_chars"), F.size(F.array_distinct("c")).cast("long").alias("n_distinct"))


@query()
def pretok_baseline_cover(spark, sf_dir):
    """Whether the chunks of the baseline and stage-2 patterns together are the text."""
    d = _documents(spark, sf_dir)
    c = {p: text.pretokens(F.col("text"), p) for p in ("baseline", "stage2")}
    return d.select("doc_id", *(F.size(x).alias(f"{p}_chunks") for p, x in c.items()), *((F.array_join(x, "") == F.col("text")).alias(f"{p}_covers") for p, x in c.items()))


@query(f"""with {LINES}, opened as (select case when length(line) % 3 = 0 then line else [{', '.join(map(_quoted, PREFIX_PUNCTUATION))}][length(line) % {len(PREFIX_PUNCTUATION)} + 1] || line end as line from lines)
select prefix, count(*) as n from (select {_case(PREFIX_PUNCTUATION, 'starts_with(line, {q})')} as prefix from opened) group by prefix""")
def affix_prefix_punct(spark, sf_dir):
    """How many distinct lines start with each prefix punctuation, two of three behind one."""
    marks = F.array(*map(F.lit, PREFIX_PUNCTUATION))
    n = F.length("line")
    opened = F.when(n % 3 == 0, F.col("line")).otherwise(F.concat(F.element_at(marks, n % len(PREFIX_PUNCTUATION) + 1), "line"))
    return _lines(spark, sf_dir).select(opened.alias("line")).groupBy(affixes.prefix_punctuation(F.col("line")).alias("prefix")).agg(F.count("*").alias("n"))


@query(f"with {LINES} select suffix, count(*) as n from (select {_case(affixes.suffix_literals(), 'ends_with(line, {q})')} as suffix from lines) group by suffix")
def affix_suffix_punct(spark, sf_dir):
    """How many distinct lines end with each suffix punctuation."""
    return _lines(spark, sf_dir).groupBy(affixes.suffix_punctuation(F.col("line")).alias("suffix")).agg(F.count("*").alias("n"))


#: Words with endings by their length: none, possessives of both kinds, with a mark before or behind.
ENDED = f"""ended as (select word || ['', {', '.join(map(_quoted, ENDINGS))}][length(word) % {len(ENDINGS) + 1} + 1] as word from surfaces)"""


def _ended(spark, sf_dir) -> DataFrame:
    ending = F.element_at(F.array(F.lit(""), *map(F.lit, ENDINGS)), F.length("word") % (len(ENDINGS) + 1) + 1)
    # The generator keeps the optimizer from copying this into each use of the word.
    return _surfaces(spark, sf_dir).select(F.explode(F.array(F.concat("word", ending))).alias("word"))


@query(f"with {SURFACES}, {ENDED} select possessive, count(*) as n from (select {_case(affixes.POSSESSIVES, 'ends_with(word, {q})')} as possessive from ended) group by possessive")
def affix_possessive(spark, sf_dir):
    """How many words end with each possessive, most of them behind one, some with a mark."""
    return _ended(spark, sf_dir).groupBy(affixes.possessive(F.col("word")).alias("possessive")).agg(F.count("*").alias("n"))


@query(f"with {LINES} select determiner, count(*) as n from (select {_case(_longest(DETERMINERS), 'starts_with(lower(line), {s})')} as determiner from lines) group by determiner")
def affix_determiner(spark, sf_dir):
    """How many distinct lines start with each determiner."""
    return _lines(spark, sf_dir).groupBy(affixes.determiner(F.col("line"), DETERMINERS).alias("determiner")).agg(F.count("*").alias("n"))


@query(f"with {LINES} select preposition, count(*) as n from (select {_case(_longest(PREPOSITIONS['full']), 'starts_with(lower(line), {s})')} as preposition from lines) group by preposition")
def affix_preposition(spark, sf_dir):
    """How many distinct lines start with each preposition of the full profile."""
    return _lines(spark, sf_dir).groupBy(affixes.preposition(F.col("line"), "full").alias("preposition")).agg(F.count("*").alias("n"))


def _strip_sql() -> str:
    step = [f"with {LINES}", "a0 as (select line, starts_with(line, ' ') as space_prefix, case when starts_with(line, ' ') then line[2:] else line end as t from lines)"]
    step.append(f"a1 as (select *, {_case(PREFIX_PUNCTUATION, 'starts_with(t, {q})')} as prefix_punct from a0)")
    step.append("a2 as (select * replace (case when prefix_punct is null then t else t[length(prefix_punct) + 1:] end as t) from a1)")
    for name, words, k in (("prep", PREPOSITIONS["core"], 3), ("article", ARTICLES, 5)):
        step.append(f"a{k} as (select *, {_case(_longest(words), 'starts_with(lower(t), {s})')} as {name} from a{k - 1})")
        step.append(f"a{k + 1} as (select * replace (case when {name} is null then t else t[length({name}) + 2:] end as t), {name} is not null and regexp_matches(t[1], '\\p{{Lu}}') as {name}_cap from a{k})")
    step.append(f"a7 as (select *, {_case(affixes.suffix_literals(), 'ends_with(t, {q})')} as suffix_punct from a6)")
    return step[0] + ", " + ", ".join(step[1:]) + " select md5(line) as line, space_prefix, prefix_punct, prep, prep_cap, article, article_cap, suffix_punct, case when suffix_punct is null then t else t[:length(t) - length(suffix_punct)] end as base from a7"


@query(_strip_sql())
def strip_all_affixes(spark, sf_dir):
    """Every distinct line's affixes and what they leave."""
    return affixes.strip_affixes(_lines(spark, sf_dir), "line").withColumn("line", F.md5(F.col("line").cast("binary")))


_LETTERS = "regexp_replace({}, '[^\\p{{L}}]', '', 'g')"
_UPPERS = "length(regexp_replace(" + _LETTERS + ", '[^\\p{{Lu}}]', '', 'g'))"


@query(f"""with {SURFACES}, u as (select word, {_LETTERS.format('word')} as l, {_UPPERS.format('word')} as up from surfaces)
select state, count(*) as n from (select case when up = 0 then 'none' when up = length(l) and up > 1 then 'all_caps'
 when regexp_matches(l[1], '\\p{{Lu}}') and up = 1 then 'first_cap' else 'all_caps_literal' end as state from u) group by state""")
def capitalization_states(spark, sf_dir):
    """How many distinct words have each capitalization."""
    return _surfaces(spark, sf_dir).groupBy(affixes.capitalization(F.col("word")).alias("state")).agg(F.count("*").alias("n"))


_KEY = "case when regexp_full_match({0}, '\\p{{L}}+') then case when regexp_full_match({0}, '\\p{{Lu}}+') then {0} else lower({0}) end end"


def _upper(x: str) -> str:
    return f"upper(replace({x}, 'ß', 'ss'))"  # one letter that has no capital of its own


@query(f"""with {SURFACES}, w as (select distinct lower(word) as base from surfaces),
v as (select base, space, state, case when space then ' ' else '' end || case state when 'none' then base when 'first_cap' then {_upper('base[1]')} || base[2:] else {_upper('base')} end as variant
 from w, (values (false), (true)) s(space), (values ('none'), ('first_cap'), ('all_caps')) c(state))
select base, variant, space, state from v where variant <> base""")
def space_cap_variants(spark, sf_dir):
    """Variants of every word of any script in lower case by space and capitalization."""
    words = _surfaces(spark, sf_dir).select(F.lower("word").alias("base")).distinct()
    return words.select("base", F.explode(affixes.variants(F.col("base"))).alias("v")).select("base", "v.variant", "v.space", "v.state")


@query(f"""with {SURFACES}, k as (select word, {_KEY.format('word')} as k from surfaces),
c as (select k, arg_min(word, (case when word = k then 0 else 3 end, word)) as c from k where k is not null group by k)
select word, coalesce(c, word) as canonical from k left join c using (k)""")
def case_space_equivalence(spark, sf_dir):
    """Canonical word of every word among those of letters that differ by capitals only; any other word is its own."""
    words = Tables(spark, "words").keep(_surfaces(spark, sf_dir).select("word"), "words").select("word", F.col("word").alias("id"))
    return metrics.equivalence(words, "id", "word", affixes.accuracy_surface(F.col("word"))).select("word", F.col("canonical_id").alias("canonical"))


@query(f"with {SURFACES} select base, arg_min(word, (first_doc, word)) as word, min(first_doc) as first_doc from (select *, lower(word) as base from surfaces) group by base")
def dedup_first_wins(spark, sf_dir):
    """Of all words with one lower-case form, in any script, that of the least document, then of the least spelling."""
    words = _surfaces(spark, sf_dir).withColumn("base", F.lower("word"))
    return corpus.first_wins(words, ["base"], ["first_doc", "word"]).select("base", "word", "first_doc")


@query(f"with {SURFACES} select base, arg_max(word, (first_doc, word)) as word from (select *, lower(word) as base from surfaces) group by base")
def last_write_wins(spark, sf_dir):
    """Of all words with one lower-case form, in any script, the one that is written last."""
    words = _surfaces(spark, sf_dir).withColumn("base", F.lower("word"))
    return corpus.last_wins(words, ["base"], ["first_doc", "word"]).select("base", "word")


def _fold(x: str) -> str:
    return "trim(regexp_replace(coalesce(" + x + r", ''), '[\p{Z}\t-\r\x{85}\x{1C}-\x{1F}]+', ' ', 'g'))"


def _squad(x: str) -> str:
    bare = f"translate(lower(coalesce({x}, '')), {_quoted(ASCII_PUNCTUATION)}, '')"
    for _ in range(2):  # a word between two others' separators is left to the second pass
        bare = f"regexp_replace({bare}, '(^|[^\\p{{L}}\\p{{N}}_])(a|an|the)([^\\p{{L}}\\p{{N}}_]|$)', '\\1 \\3', 'g')"
    return _fold(bare)


@query(f"select conv_id, turn, md5({_squad('text')}) as digest, coalesce({_fold('text')} = text, false) as folded from conversations")
def squad_normalize(spark, sf_dir):
    """Answer normalization of every turn in any script; of a null one, an empty text."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.md5(scoring.squad_normalized(F.col("text")).cast("binary")).alias("digest"), F.coalesce(scoring.fold_spaces(F.col("text")) == F.col("text"), F.lit(False)).alias("folded"))


@query(f"""with n as (select conv_id, turn, text, {_fold('text')} as p from conversations),
j as (select a.conv_id, a.turn, a.p as p, {_fold("case a.conv_id % 4 when 0 then ' ' || replace(a.text, ' ', '  ') when 1 then a.text[:12] when 2 then a.text[6:14] else b.text end")} as q from n a join n b on a.conv_id = b.conv_id and b.turn = a.turn - 1)
select conv_id, turn, p <> '' and q <> '' and p = q as exact, p <> '' and q <> '' and starts_with(p, q) as prefix, p <> '' and q <> '' and contains(p, q) as has from j""")
def em_match(spark, sf_dir):
    """Whether a turn equals, starts with or contains an answer: its own words further apart, its beginning, a part of it, or the turn before."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    b = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    kind = F.col("conv_id") % 4
    own = F.when(kind == 0, F.concat(F.lit(" "), F.replace("text", F.lit(" "), F.lit("  ")))).when(kind == 1, F.substring("text", 1, 12)).when(kind == 2, F.substring("text", 6, 9))
    j = c.join(b, ["conv_id", "turn"]).withColumn("answer", F.when(kind == 3, F.col("before")).otherwise(own))
    p, a = F.col("text"), F.array("answer")
    return j.select("conv_id", "turn", scoring.em_match(p, a, "exact").alias("exact"), scoring.em_match(p, a, "prefix").alias("prefix"), scoring.em_match(p, a, "contains").alias("has"))


@query(r"""with c as (select conv_id, turn, case turn % 3 when 0 then text when 1 then text || ' costs -' || (conv_id * 7)::varchar || ',250.5' || turn::varchar || chr(10) || 'or 9' else chr(10) || ' ' || text || ': +' || conv_id::varchar || ' ' || chr(10) || '1' end as text from conversations)
select conv_id, turn, nullif(replace(regexp_extract(text, '([-+]?[0-9][0-9,]*(?:\.[0-9]+)?)', 1), ',', ''), '') as number,
md5(regexp_extract(text, '([^\s](?:[^\n\r\x0b\x0c]*[^\s])?)', 1)) as line from c""")
def first_number_and_line(spark, sf_dir):
    """The first number and the first line of every turn, as it is, with a price and another line behind it, or between blanks with a signed number."""
    c, n = table(spark, sf_dir, "conversations"), lambda x: x.cast("string")
    price = F.concat("text", F.lit(" costs -"), n(F.col("conv_id") * 7), F.lit(",250.5"), n(F.col("turn")), F.lit("\nor 9"))
    signed = F.concat(F.lit("\n "), "text", F.lit(": +"), n(F.col("conv_id")), F.lit(" \n1"))
    c = c.withColumn("text", F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, price).otherwise(signed))
    return c.select("conv_id", "turn", scoring.first_number(F.col("text")).alias("number"), F.md5(scoring.first_line(F.col("text")).cast("binary")).alias("line"))


@query("""select conv_id, turn, md5(case when i > 0 then text[:i - 1] else text end) as cut from
(select *, coalesce(least(nullif(instr(text, '. '), 0), nullif(instr(text, chr(10)), 0)), 0) as i from conversations)""")
def stop_strings(spark, sf_dir):
    """Every turn up to its first sentence end or line feed."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.md5(scoring.cut_at_stops(F.col("text"), [". ", "\n"]).cast("binary")).alias("cut"))


@query("""with g as (select o_custkey, n, c, unnest([1, 5, 10]) as k from (select o_custkey, count(*) as n, count(*) filter (where o_orderstatus = 'F') as c from orders group by o_custkey))
select o_custkey, n, c, k::bigint as k, round(case when c <= 0 then 0.0 when n - c < k then 1.0 else
 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1.0::double - k::double / i)) end, 9) as pass from g""")
def pass_at_k(spark, sf_dir):
    """The estimator over the orders of every customer, finished ones as right samples."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("c"))
    g = o.withColumn("k", F.explode(F.array(*(F.lit(k).cast("long") for k in (1, 5, 10)))))
    return g.select("o_custkey", "n", "c", "k", F.round(scoring.pass_at_k(F.col("n"), F.col("c"), F.col("k")), 9).alias("pass"))


#: Losses that SQL can make again: of each position of each document's words.
LOSSES = """tokens as (select doc_id, lang, unnest(string_split(text, ' ')) as w, generate_subscripts(string_split(text, ' '), 1) as pos from documents),
losses as (select doc_id, lang, strlen(w) as size, case when pos % 17 = 0 then -1 else length(w) end as target, (pos + doc_id) % 9 as pred, ((pos * 31 + doc_id * 7) % 97) / 97.0::double as loss from tokens)"""


def _losses(spark, sf_dir):
    t = _documents(spark, sf_dir).select("doc_id", "lang", F.posexplode(F.split("text", " ")).alias("pos", "w")).withColumn("pos", F.col("pos") + 1)
    return t.select(
        "doc_id", "lang", F.octet_length("w").alias("size"), F.when(F.col("pos") % 17 == 0, -1).otherwise(F.length("w")).alias("target"),
        ((F.col("pos") + F.col("doc_id")) % 9).alias("pred"), (((F.col("pos") * 31 + F.col("doc_id") * 7) % 97) / 97.0).alias("loss"),
    )


@query(f"with {LOSSES} select lang, round(sum(loss), 3) as nats, sum(size) as bytes, round(sum(loss) / (ln(2) * sum(size)), 8) as bpb from losses where target >= 0 and size > 0 group by lang")
def bpb(spark, sf_dir):
    """Bits per byte of each language."""
    return metrics.bits_per_byte(_losses(spark, sf_dir), ["lang"], "loss", "target", "size").select("lang", F.round("nats", 3).alias("nats"), "bytes", F.round("bpb", 8).alias("bpb"))


@query(f"""with {LOSSES} select lang, round(count(*) filter (pred = target) / count(*)::double, 9) as accuracy,
round(sum(size) filter (pred = target) / sum(size)::double, 9) as byte_accuracy from losses where target >= 0 and size > 0 group by lang""")
def token_accuracy(spark, sf_dir):
    """Plain and byte-weighted accuracy of each language."""
    a = metrics.accuracy(_losses(spark, sf_dir), ["lang"], "pred", "target", "size")
    return a.select("lang", F.round("accuracy", 9).alias("accuracy"), F.round("byte_accuracy", 9).alias("byte_accuracy"))


@query(f"with {LOSSES} select min(size) as min_bytes, max(size) as max_bytes, round(avg(size), 9) as mean_bytes, round(stddev_samp(size), 6) as std_bytes from losses where size > 0")
def token_byte_stats(spark, sf_dir):
    """Byte lengths of all words."""
    s = metrics.token_byte_stats(_losses(spark, sf_dir), "size")
    return s.select("min_bytes", "max_bytes", F.round("mean_bytes", 9).alias("mean_bytes"), F.round("std_bytes", 6).alias("std_bytes"))


@query(f"with {LOSSES}, m as (select doc_id, pred, avg(loss) as l from losses group by all) select doc_id, arg_min(pred, (round(l, 9), pred)) as chosen from m group by doc_id")
def choice_by_loss(spark, sf_dir):
    """Of each document's choices that of least mean loss, the first on a tie."""
    m = _losses(spark, sf_dir).groupBy("doc_id", "pred").agg(F.round(F.avg("loss"), 9).alias("l"))
    return metrics.best_choice(m, ["doc_id"], "pred", "l")


_TASK_SQL = """tasks as (select coalesce(source, 'none') || '/' || coalesce(lang, 'none') as task, coalesce(lang, 'none') as category, avg(quality)::double as score, case when length(coalesce(source, 'none')) % 2 = 0 then 25.0 else 0.0 end::double as baseline
from documents join labels using (doc_id) group by source, lang)"""


def _tasks(spark, sf_dir):
    """Tasks as an evaluation gives them: the share of good documents of each source and language, against a baseline."""
    d = _documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    name, lang = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none"))
    d = d.groupBy(name.alias("s"), lang.alias("category")).agg(F.avg("quality").alias("score"))
    return d.select(F.concat("s", F.lit("/"), "category").alias("task"), "category", "score", F.when(F.length("s") % 2 == 0, 25.0).otherwise(0.0).alias("baseline"))


@query(f"with {_TASK_SQL} select task, round((score - 0.01 * baseline) / (1 - 0.01 * baseline), 9) as centered from tasks union all select 'CORE', round(avg((score - 0.01 * baseline) / (1 - 0.01 * baseline)), 9) from tasks")
def core_centered(spark, sf_dir):
    """Centred scores of the tasks and their mean."""
    t = metrics.centered(_tasks(spark, sf_dir), "score", "baseline")
    return t.select("task", F.round("centered", 9).alias("centered")).union(metrics.composite(_tasks(spark, sf_dir), "score", "baseline").select(F.lit("CORE"), F.round("core", 9)))


@query(f"with {_TASK_SQL} select category, round(avg(score), 9) as score, count(*) as n_tasks from tasks group by category")
def downstream_mean(spark, sf_dir):
    """Mean score of each category of the tasks."""
    return metrics.by_category(_tasks(spark, sf_dir), "category", "score").withColumn("score", F.round("score", 9))


@query("""with l as (select vec_id, unnest(embedding)::double as logit, generate_subscripts(embedding, 1) - 1 as token from embeddings),
r as (select *, row_number() over (partition by vec_id order by logit desc, token) as n from l), t as (select * from r where n <= 20),
e as (select *, exp((logit - max(logit) over (partition by vec_id)) / 0.1) as e from t), p as (select *, e / sum(e) over (partition by vec_id) as p from e),
c as (select *, sum(p) over (partition by vec_id order by n rows unbounded preceding) as c from p), k as (select * from c where n = 1 or c <= 0.9)
select vec_id, count(*) as kept, sum(token) as token_sum from k group by vec_id""")
def topk_topp_keep_set(spark, sf_dir):
    """Size and ids of what top-k and top-p leave of each vector, read as logits."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("token", "logit")).withColumn("logit", F.col("logit").cast("double"))
    k = metrics.keep_set(e, "vec_id", "token", "logit", 20, 0.9, 0.1)
    return k.groupBy("vec_id").agg(F.count("*").alias("kept"), F.sum("token").alias("token_sum"))


@query("""with l as (select vec_id, unnest(embedding)::double as logit, generate_subscripts(embedding, 1) - 1 as token from embeddings),
r as (select *, row_number() over (partition by vec_id order by logit desc, token) as n from l), t as (select * from r where n <= 20),
e as (select *, exp((logit - max(logit) over (partition by vec_id)) / 0.1) as e from t), p as (select *, e / sum(e) over (partition by vec_id) as p from e),
c as (select *, sum(p) over (partition by vec_id order by n rows unbounded preceding) as c from p), k as (select * from c where n = 1 or c <= 0.9),
q as (select *, p / sum(p) over (partition by vec_id) as share from k), u as (select *, sum(share) over (partition by vec_id order by n rows unbounded preceding) as upto, ((vec_id * 37) % 100)::double / 100 + 0.005 as chance from q)
select vec_id, coalesce(arg_min(token, n) filter (where upto > chance), arg_max(token, n)) as token from u group by vec_id""")
def drawn_tokens(spark, sf_dir):
    """The token that is drawn for each vector, read as logits, from what top-k and top-p leave, by a chance that its id gives."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("token", "logit")).withColumn("logit", F.col("logit").cast("double"))
    k = metrics.keep_set(e, "vec_id", "token", "logit", 20, 0.9, 0.1)
    return metrics.drawn(k, "vec_id", "token", (F.col("vec_id") * 37 % 100) / 100.0 + 0.005)


@query("""select doc_id, round(case when s < 40 then (s + 1) / 40.0::double when s <= 600 then 1.0 else (1000 - s) / 400.0::double + (1 - (1000 - s) / 400.0::double) * 0.1 end, 9) as rate,
round(case when s < 400 then (1 - s / 400.0::double) * 0.85 + s / 400.0::double * 0.97 when s >= 600 then 0.97 * (1 - (s - 600) / 400.0::double) + 0.9 * (s - 600) / 400.0::double else 0.97 end, 9) as momentum from (select doc_id, doc_id % 1000 as s from documents)""")
def schedules(spark, sf_dir):
    """Learning-rate multiplier and momentum at the step at which each document comes, of a thousand."""
    s = _documents(spark, sf_dir).select("doc_id", (F.col("doc_id") % 1000).alias("step"))
    return s.select("doc_id", F.round(metrics.rate_multiplier(F.col("step"), 1000, 40, 400, 0.1), 9).alias("rate"), F.round(metrics.momentum(F.col("step"), 1000, 400, 0.9), 9).alias("momentum"))


@query("select conv_id, turn, min(length(text)) over (partition by conv_id order by turn) as least from conversations")
def running_minimum(spark, sf_dir):
    """Least length of a conversation's turns so far."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return metrics.running_minimum(c, "conv_id", "turn", "n").select("conv_id", "turn", "least")


_BASE_KEY = r"case when length(ltrim(base, ' ')) = 0 then null when regexp_matches(base, '\p{L}') and not regexp_matches(base, '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]') then ltrim(base, ' ') else lower(ltrim(base, ' ')) end"
_STATE = f"""case when {_UPPERS.format('base')} = 0 then 'none' when {_UPPERS.format('base')} = length({_LETTERS.format('base')}) and {_UPPERS.format('base')} > 1 then 'all_caps'
 when regexp_matches({_LETTERS.format('base')}[1], '\\p{{Lu}}') and {_UPPERS.format('base')} = 1 then 'first_cap' else 'all_caps_literal' end"""


def _collision_sql() -> str:
    inner = "select word[:2] || upper(word[i]) || word[4:] as line from surfaces, (values (3)) v(i) where regexp_full_match(word, '[a-z]{5,}') union select word[:3] || upper(word[4]) || word[5:] from surfaces where regexp_full_match(word, '[a-z]{5,}')"
    every = f"lines as (select word as line from surfaces union {inner} union select line from (select distinct unnest(string_split(text, chr(10))) as line from documents) where line is not null)"
    stripped = _strip_sql().replace(LINES, f"{SURFACES}, {every}").replace("md5(line) as line", "line")
    keys = "base_key, space_prefix, prefix_punct, prep, prep_cap, article, article_cap, suffix_punct, capitalization"
    return f"""with b as ({stripped}), k as (select *, {_BASE_KEY} as base_key, {_STATE} as capitalization from b)
select {keys}, count(distinct line) as n, min(line) as first from k where coalesce(base_key, '') <> '' group by {keys} having count(distinct line) > 1"""


@query(_collision_sql())
def surface_collisions(spark, sf_dir):
    """Bases and modifiers that several different words or lines decompose to; words come with a capital inside as well, which no modifier tells apart."""
    words = _surfaces(spark, sf_dir).select(F.col("word").alias("surface"))
    inner = lambda i: F.concat(F.substring("surface", 1, i - 1), F.upper(F.substring("surface", i, 1)), F.expr(f"substring(surface, {i + 1})"))
    capital = words.where(F.col("surface").rlike("^[a-z]{5,}$")).select(F.explode(F.array(inner(3), inner(4))).alias("surface"))
    surfaces = words.union(capital).union(_lines(spark, sf_dir).where("line is not null")).distinct()
    return metadata.surface_collisions(surfaces, "surface")


@query(f"with {SURFACES} select word, replace(regexp_replace(regexp_replace(word, '(\\p{{Ll}})(\\p{{Lu}})', '\\1' || chr(1) || '\\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1' || chr(1) || '\\2', 'g'), chr(1), ' ') as parts from surfaces")
def camel_case(spark, sf_dir):
    """Parts of every word of any script at its changes of case."""
    return _surfaces(spark, sf_dir).select("word", F.array_join(affixes.camel_parts(F.col("word")), " ").alias("parts"))


@query("select doc_id, sha256(text) as digest from documents")
def file_digests(spark, sf_dir):
    """SHA-256 of every text."""
    return corpus.digests(_documents(spark, sf_dir).select("doc_id", F.col("text").cast("binary").alias("content")), "doc_id", "content")


def _base_sql(before: str = " ") -> str:
    """The stripped surfaces: words, behind a space or not, in place of lines."""
    return _strip_sql().replace(LINES, f"{SURFACES}, lines as (select '{before}' || word as line from surfaces)").replace("md5(line) as line", "line")


def _vocabulary(spark, sf_dir, before: str = " "):
    word = F.concat(F.lit(before), "word")
    return _surfaces(spark, sf_dir).select(word.alias("surface"), word.alias("id"))


@query(f"with b as ({_base_sql()}), k as (select line, {_BASE_KEY} as base_key from b) select base_key, min(line) as first_id, count(distinct line) as n_variants from k where coalesce(base_key, '') <> '' group by base_key")
def vocab_bases(spark, sf_dir):
    """Bases of all the corpus's words, with the first word and the number of words that decompose to each."""
    return metadata.bases(_vocabulary(spark, sf_dir), "id", "surface")


@query(f"with b as ({_base_sql('')}), k as (select line, {_BASE_KEY} as base_key from b) select line as id from k where coalesce(base_key, '') = '' or base_key = line")
def vocab_survivors(spark, sf_dir):
    """Words of any script that decompose to nothing else."""
    return metadata.survivors(_vocabulary(spark, sf_dir, ""), "id", "surface")


_IDS = "ids as (select doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) as ids from documents)"


def _word_lengths(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("ids"))


@query(f"""with {_IDS} select doc_id, (select max(len(ids)) from ids) as padded, list_sum(ids) as total, list_sum(ids[-50:]) as tail, len(ids) as n,
coalesce(list_position(ids, 9) - 1, len(ids)) as kept, len(ids) - 1 as targets, coalesce(list_sum(ids[2:]), 0) as target_sum from ids""")
def pad_tail_stop_shift(spark, sf_dir):
    """Word lengths of every document padded to the longest, their last 50, those before the first 9, and the targets of a shift."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    p = sequences.stacked(_word_lengths(spark, sf_dir).withColumn("real", F.col("ids")), "ids", -1)
    kept = F.filter("ids", lambda x: x >= 0)
    return p.select(
        "doc_id", F.size("ids").alias("padded"), total(kept).alias("total"), total(sequences.tail(F.col("real"), 50)).alias("tail"), F.size(kept).alias("n"),
        F.size(sequences.before_stop(F.col("real"), [9])).alias("kept"), F.size(sequences.shifted(F.col("real"))[1]).alias("targets"), total(sequences.shifted(F.col("real"))[1]).alias("target_sum"),
    )


@query("""with c as (select conv_id, turn, repeat('so on ', (conv_id % 3)::int) || text as text from conversations), w as (select conv_id, turn, string_split(text, ' ') as a, lead(string_split(text, ' ')) over (partition by conv_id order by turn) as b from c)
select conv_id, turn, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) as shared from w where b is not null""")
def common_prefixes(spark, sf_dir):
    """Words that a turn and the next one start with alike, behind a beginning that a conversation's turns share."""
    from pyspark.sql import Window

    text = F.concat(F.expr("repeat('so on ', cast(conv_id % 3 as int))"), "text")
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split(text, " ").alias("a"))
    w = w.withColumn("b", F.lead("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null")
    return w.select("conv_id", "turn", sequences.common_prefix(F.col("a"), F.col("b")).alias("shared"))


_ENTRY_SQL = """words as (select conv_id * 1000 + turn as k, string_split(text, ' ') as ids from conversations),
places as (select k, ids, unnest(range(1, len(ids) + 1)) as p from words), runs as (select k, p, n, ids[p:p + n - 1] as r from places, (values (1), (2), (3)) v(n) where p + n - 1 <= len(ids)),
entries as (select r, array_to_string(r, '_') as entry from runs group by r having count(*) >= 5)"""


@query(f"with {_ENTRY_SQL} select k, p - 1 as pos, max(n) as n, arg_max(entry, n) as entry from runs join entries using (r) group by k, p")
def longest_prefix_join(spark, sf_dir):
    """At every word of every turn the longest of the runs of up to three words that occur five times."""
    stream = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), F.split("text", " ").alias("ids"))
    entries = metrics.runs(stream, "ids", 3).groupBy("token_ids").count().where("count >= 5").select("token_ids", F.array_join("token_ids", "_").alias("entry"))
    return metrics.longest_prefix_entries(stream, entries, "k", "ids", 3)


@query()
def few_shot_samples(spark, sf_dir):
    """Four other turns for each turn of the roles' tasks, drawn by a seeded generator."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").withColumn("i", F.row_number().over(Window.partitionBy("role").orderBy("conv_id", "turn")).cast("long") - 1)
    return sequences.few_shots(c, "role", "i", 4)


def _literal_sql(group: int, step: int) -> str:
    values = composition.GROUPS[group][1]
    return f"[{', '.join(map(_quoted, values))}][(first_doc * {step} + length(word)) % {len(values)} + 1]"


@query(f"""with {SURFACES}, w as (select word, {_literal_sql(2, 3)} as det, {_literal_sql(4, 5)} as prep, {_literal_sql(6, 7)} as prefix, {_literal_sql(7, 11)} as suffix, length(word) % 2 as space from surfaces)
select word, (strlen(repeat(' ', space::int) || prefix || case when prep <> '' then prep || ' ' else '' end || case when det <> '' then det || ' ' else '' end || word || suffix) - strlen(word))::bigint as delta from w""")
def modifier_bytes(spark, sf_dir):
    """Bytes that modifiers of every group, in all combinations of their values, add to the words of the corpus."""
    w = _surfaces(spark, sf_dir)
    value = lambda g, step: ((F.col("first_doc") * step + F.length("word")) % len(composition.GROUPS[g][1])).cast("int")
    row = F.array(F.length("word") % 2, F.lit(0), value(2, 3), F.lit(0), value(4, 5), F.lit(0), value(6, 7), value(7, 11))
    return w.select("word", metadata.utf8_delta(row).cast("long").alias("delta"))


#: Vocabulary size of the small tokenizer that the queries train.
VOCABULARY = 400


def _trained(spark, sf_dir):
    return bpe.fitted(spread(_documents(spark, sf_dir)), "text", VOCABULARY)


@query()
def bpe_encode_counts(spark, sf_dir):
    """Tokens and bytes per token of each language under a vocabulary trained on the corpus."""
    d = spread(_documents(spark, sf_dir)).withColumn("bytes", F.octet_length("text"))
    e = bpe.encoded(d, "doc_id", "text", _trained(spark, sf_dir), keep=("lang", "bytes"))
    return e.groupBy("lang").agg(F.sum("bytes").alias("bytes"), F.sum(F.size("ids")).alias("tokens")).withColumn("bytes_per_token", F.try_divide("bytes", "tokens"))


@query("select doc_id, md5(coalesce(text, '')) as digest from documents")
def bpe_roundtrip(spark, sf_dir):
    """Digest of every document, encoded and decoded."""
    m = _trained(spark, sf_dir)
    out = bpe.decoded(bpe.encoded(spread(_documents(spark, sf_dir)), "doc_id", "text", m), "doc_id", "ids", m)
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("select doc_id, true as same, length(text) > 0 as some from documents")
def compose_identity(spark, sf_dir):
    """Whether every document is its units' surfaces, end to end, and has any unit."""
    c = composition.composed(spread(_documents(spark, sf_dir)), "doc_id", "text")
    return c.select("doc_id", F.col("round_trip").alias("same"), (F.col("n_units") > 0).alias("some"))


@query()
def compose_roundtrip(spark, sf_dir):
    """Units of every document as words and modifiers, and whether they decode to it."""
    return composition.composed(spread(_documents(spark, sf_dir)), "doc_id", "text").drop("usage")


@query()
def compression_stats(spark, sf_dir):
    """Positions with and without composition, and how often each group is used, in each language."""
    c = composition.composed(spread(_documents(spark, sf_dir)), "doc_id", "text", keep=("lang",))
    usage = [F.sum(F.col("usage")[g]).alias(name) for g, (name, _) in enumerate(composition.GROUPS)]
    out = c.groupBy("lang").agg(F.sum("n_words").alias("raw"), F.sum("n_units").alias("compressed"), F.sum("n_active").alias("active"), F.sum("n_multi").alias("multi"), F.bool_and("round_trip").alias("round_trip"), *usage)
    return out.withColumn("ratio", F.try_divide("compressed", "raw"))


@query()
def pack_rows(spark, sf_dir):
    """Rows of 2049 words for four ranks by best fit with cropping."""
    d = _documents(spark, sf_dir).select("doc_id", (F.size(F.split("text", " ")) + 1).alias("n"))
    p = rows.packed_rows(d, "doc_id", "n", 2049, 4)
    return p.groupBy("rank", "row_no").agg(F.sum("taken").alias("taken"), F.count("*").alias("n_docs"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-normalized texts in whitespace-isolated chunks: documents, chunks, characters and bytes of each language."""
    d = _documents(spark, sf_dir).select("lang", text.lower_except_all_caps(F.col("text")).alias("text"))
    return d.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.size(text.pretokens(F.col("text")))).alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"), F.sum(F.octet_length("text")).alias("n_bytes"))


query(f"""with n as ({_word_sql(f"case when regexp_full_match(w[i], '[A-Z][^A-Z]*[a-z][^A-Z]*') then {_LOWER.format('w[i]')} else w[i] end").replace('doc_id, md5(', 'lang, (').replace('select doc_id, string', 'select lang, string').replace('as digest', 'as text')})
select lang, count(*) as n_docs, sum(len(regexp_extract_all(text, '{_ISOLATING_RE2}'))) as n_chunks, sum(length(text)) as n_chars, sum(strlen(text)) as n_bytes from n group by lang""")(flagship)
