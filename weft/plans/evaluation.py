"""Registered queries of scoring, gathers, surfaces and task rows, each over whole tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.functions import affixes, scoring, surfaces
from weft.functions.literals import PREPOSITIONS
from weft.operators import corpus as preparation
from weft.operators import evaluation, metrics, sequences
from weft.plans import metadata
from weft.plans import queries as core
from weft.plans.queries import _BASE_KEY, _LETTERS, _STATE, LOSSES, SURFACES, _base_sql, _documents, _fold, _lines, _losses, _quoted, _squad, _strip_sql, _surfaces, _vocabulary, table
from weft.sources import corpus, datasets
from weft.sources.shared import Tables, spread

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _turns(spark, sf_dir):
    """Every turn with the one before it in its conversation."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return c.join(c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before")), ["conv_id", "turn"])


TURNS = "turns as (select a.conv_id, a.turn, a.role, a.text, b.text as before from conversations a join conversations b on a.conv_id = b.conv_id and a.turn = b.turn + 1)"


@query(f"with {TURNS} select role as task, round(avg((length(text) > length(before))::int), 9) as accuracy, count(*) as n from turns group by role")
def task_accuracy(spark, sf_dir):
    """Share of turns longer than the one before, by role."""
    t = _turns(spark, sf_dir).select(F.col("role").alias("task"), (F.length("text") > F.length("before")).alias("correct"))
    return evaluation.task_accuracy(t, "task", "correct").withColumn("accuracy", F.round("accuracy", 9))


@query(f"with {TURNS}, s as (select conv_id % 3 as split, avg((length(text) > length(before))::int) as a from turns group by 1) select round(avg(a), 9) as accuracy, count(*) as n_splits from s")
def mean_of_splits(spark, sf_dir):
    """The mean of three splits' accuracies."""
    t = _turns(spark, sf_dir).select((F.col("conv_id") % 3).alias("split"), (F.length("text") > F.length("before")).alias("correct"))
    return evaluation.mean_of_splits(t, "split", "correct").withColumn("accuracy", F.round("accuracy", 9))


@query(f"""with t as (select conv_id, turn, text, case conv_id % 3 when 0 then ' SQuAD ' when 1 then 'coqa' else 'lambada' end as task, 'The ' || text || '!' as predicted from conversations),
p as (select *, case when lower(trim(task)) in ('squad', 'coqa') then 'squad_qa' else 'none' end as policy from t)
select conv_id, turn, policy, case when policy = 'squad_qa' then {_squad('predicted')} = {_squad('text')} else coalesce(predicted, '') = coalesce(text, '') end as same from p""")
def normalized_match(spark, sf_dir):
    """Whether an answer behind an article and before a mark is the turn itself, as each task's rule compares them."""
    task = F.when(F.col("conv_id") % 3 == 0, " SQuAD ").when(F.col("conv_id") % 3 == 1, "coqa").otherwise("lambada")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", surfaces.normalization_policy(task).alias("policy"), F.concat(F.lit("The "), "text", F.lit("!")).alias("predicted"))
    return t.select("conv_id", "turn", "policy", (surfaces.for_policy(F.col("predicted"), F.col("policy")) == surfaces.for_policy(F.col("text"), F.col("policy"))).alias("same"))


_ROWS = """w as (select conv_id, turn, string_split(text, ' ') as w from conversations),
g as (select conv_id, turn, list_transform(w, lambda x: length(x)) as ids, list_transform(w, lambda x: [length(x) % 3, length(x) % 2]) as rows from w),
p as (select *, list_transform(ids, lambda x, i: case when turn % 3 = 0 and i % 7 = 0 then x + 1 else x end) as pred,
 list_transform(rows, lambda r, i: case when i = len(rows) and turn % 2 = 0 then [r[1], 1] when i = 3 and turn % 5 = 0 then [r[1] + 1, r[2]] else r end) as pred_rows from g)"""


@query(f"""with {_ROWS} select conv_id, turn, pred = ids as ids_match,
list_transform(pred_rows, lambda r, i: case when rows[len(rows)][2] = 0 and i = len(rows) then [r[1], 0] else r end) = rows as rows_match from p""")
def lm_exact_match(spark, sf_dir):
    """Ids and modifier rows of altered turns against the turns' own; a suffix predicted where the last row has none doesn't count."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("ids"))
    c = c.withColumn("rows", F.transform("ids", lambda n: F.array(n % 3, n % 2)))
    end = F.size("rows") - 1
    pred = F.transform("ids", lambda x, i: F.when((F.col("turn") % 3 == 0) & ((i + 1) % 7 == 0), x + 1).otherwise(x))
    pred_rows = F.transform("rows", lambda r, i: F.when((i == end) & (F.col("turn") % 2 == 0), F.array(r[0], F.lit(1))).when((i == 2) & (F.col("turn") % 5 == 0), F.array(r[0] + 1, r[1])).otherwise(r))
    return c.select("conv_id", "turn", evaluation.exact_match(pred, F.col("ids")).alias("ids_match"), evaluation.modifiers_match(pred_rows, F.col("rows"), 1, 0).alias("rows_match"))


@query(f"""with {LOSSES}, g as (select lang, loss, [loss / 2, loss / 3, size / 100.0::double] as groups, target >= 0 as m from losses),
s as (select lang, loss, list_sum(groups) as mod, m::int::double as m from g)
select lang, round(sum(loss * m) / greatest(sum(m), 1.0), 8) as base_loss, round(sum(mod * m) / greatest(sum(m), 1.0), 8) as modifier_loss,
round(sum(loss * m) / greatest(sum(m), 1.0) + 0.5 * sum(mod * m) / greatest(sum(m), 1.0), 8) as loss from s group by lang""")
def modifier_loss(spark, sf_dir):
    """Masked base loss, added group losses and their weighted sum, by language."""
    t = _losses(spark, sf_dir)
    groups = F.array(F.col("loss") / 2, F.col("loss") / 3, F.col("size") / 100.0)
    out = evaluation.weighted_loss(t, ["lang"], F.col("loss"), groups, F.col("target") >= 0, 1.0, 0.5)
    return out.select("lang", *(F.round(c, 8).alias(c) for c in ("base_loss", "modifier_loss", "loss")))


@query(f"with {LOSSES} select doc_id, round(sum(loss + loss / 2 + loss / 3), 6) as surface_loss from losses group by doc_id")
def surface_loss(spark, sf_dir):
    """Loss of each document's surfaces: base and groups added."""
    t = _losses(spark, sf_dir).select("doc_id", evaluation.surface_loss(F.col("loss"), F.array(F.col("loss") / 2, F.col("loss") / 3)).alias("l"))
    return t.groupBy("doc_id").agg(F.round(F.sum("l"), 6).alias("surface_loss"))


@query(f"""with {SURFACES}, t as (select doc_id, unnest(string_split_regex(text, '[ \\n]+')) as word from documents)
select doc_id, sum(coalesce(strlen(s.word), 0))::bigint as n_bytes from t left join surfaces s using (word) where t.word <> '' group by doc_id""")
def gathered_bytes(spark, sf_dir):
    """Bytes of each document's words, gathered from a table of the words' byte lengths."""
    words = _documents(spark, sf_dir).select("doc_id", F.explode(F.split("text", "[ \n]+")).alias("word")).where("word <> ''")
    sizes = _surfaces(spark, sf_dir).select("word", F.octet_length("word").alias("n"))
    return evaluation.gathered(words, "word", sizes, "word", "n", 0).groupBy("doc_id").agg(F.sum("n").cast("long").alias("n_bytes"))


@query(f"""with {TURNS}, {SURFACES}, pairs as (select conv_id, turn, unnest(string_split(text, ' ')[:len(string_split(before, ' '))]) as target, unnest(string_split(before, ' ')[:len(string_split(text, ' '))]) as pred from turns),
k as (select word, {core._KEY.format('word')} as k from surfaces), c as (select k, arg_min(word, (case when word = k then 0 else 3 end, word)) as c from k where k is not null group by k),
m as (select word, coalesce(c, word) as canonical from k left join c using (k))
select conv_id, count(*) as n, sum((coalesce(a.canonical, target) = coalesce(b.canonical, pred))::int)::bigint as hits from pairs left join m a on a.word = target left join m b on b.word = pred group by conv_id""")
def canonical_hits(spark, sf_dir):
    """Words of a turn that the turn before has at the same place, alike but for capitals: both sides gathered to their canonical word."""
    n = F.least(F.size(F.split("text", " ")), F.size(F.split("before", " ")))
    pairs = _turns(spark, sf_dir).select("conv_id", F.explode(F.arrays_zip(F.slice(F.split("text", " "), F.lit(1), n).alias("target"), F.slice(F.split("before", " "), F.lit(1), n).alias("pred"))).alias("z")).select("conv_id", "z.target", "z.pred")
    m = metrics.equivalence(_surfaces(spark, sf_dir).select("word", F.col("word").alias("id")), "id", "word", affixes.accuracy_surface(F.col("word"))).select("word", "canonical_id")
    for side in ("target", "pred"):
        pairs = evaluation.gathered(pairs, side, m, "word", "canonical_id").withColumn(side, F.coalesce("canonical_id", side)).drop("canonical_id")
    return pairs.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("target") == F.col("pred")).alias("hits"))


_BASELINES = [("user", 10.0), ("assistant", 40.0), ("system", 0.0)]


@query(f"""with {TURNS}, b(task, baseline) as (values {', '.join(f"('{t}', {x}::double)" for t, x in _BASELINES)}),
a as (select role as task, avg((length(text) > length(before))::int) as acc from turns group by role)
select task, round((acc - 0.01 * baseline) / (1 - 0.01 * baseline), 9) as centered from a join b using (task)""")
def centered_by_role(spark, sf_dir):
    """Accuracies of the roles against a table of their random baselines."""
    t = _turns(spark, sf_dir).select(F.col("role").alias("task"), (F.length("text") > F.length("before")).alias("correct"))
    base = spark.createDataFrame(_BASELINES, "task string, baseline double")
    j = evaluation.task_accuracy(t, "task", "correct").join(F.broadcast(base), "task")
    return metrics.centered(j, "accuracy", "baseline").select("task", F.round("centered", 9).alias("centered"))


@query(f"""with {TURNS}, w as (select conv_id, turn, string_split(before, ' ') as a, string_split(text, ' ') as b from turns),
p as (select *, least(len(a), len(b)) as m, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) as s from w)
select conv_id, turn, s as start, len(b) - len(list_filter(range(1, m - s + 1), lambda i: a[len(a) - i + 1:] = b[len(b) - i + 1:])) as end from p""")
def span_of_change(spark, sf_dir):
    """What a turn has that the turn before hasn't, between what they begin and end with alike."""
    start, end = evaluation.span_of_change(F.split("before", " "), F.split("text", " "))
    return _turns(spark, sf_dir).select("conv_id", "turn", start.alias("start"), end.alias("end"))


@query("""with w as (select conv_id, string_split(repeat('so on ', (conv_id % 3)::int) || text || repeat(' in end', (conv_id % 2)::int), ' ') as a from conversations), s as (select conv_id, min(len(a)) as least from w group by conv_id),
f as (select conv_id, i, count(distinct a[i]) as f, count(distinct a[len(a) - i + 1]) as b from w join s using (conv_id), unnest(range(1, least + 1)) u(i) group by conv_id, i)
select s.conv_id, coalesce(min(case when f > 1 then i end) - 1, any_value(least)) as prefix, coalesce(min(case when b > 1 then i end) - 1, any_value(least)) as suffix from s left join f using (conv_id) group by s.conv_id""")
def shared_ends(spark, sf_dir):
    """Words that all turns of a conversation begin and end with, with some before and behind each that its turns share."""
    text = F.concat(F.expr("repeat('so on ', cast(conv_id % 3 as int))"), "text", F.expr("repeat(' in end', cast(conv_id % 2 as int))"))
    c = table(spark, sf_dir, "conversations").select("conv_id", F.split(text, " ").alias("ids"))
    return metrics.shared_prefix(c, "conv_id", "ids").select("conv_id", "prefix", "suffix")


@query(r"""with t as (select conv_id, turn, regexp_extract(coalesce(text, ''), '([^\s](?:[^\n\r\x0b\x0c]*[^\s])?)', 1) as line, '#### ' || (conv_id * 1000 + turn)::varchar || ',5 ' || text as worked from conversations)
select conv_id, turn, trim(regexp_extract(line, '^([^\s]*)', 1), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~') as word, nullif(replace(regexp_extract(worked, '####\s*(-?[0-9.,]+)', 1), ',', ''), '') as number,
md5(trim(regexp_extract('Say' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || 'end', '(?s)```(?:python)?\s*\n(.*?)\n```', 1))) as code, md5(trim(coalesce(text, ''))) as plain from t join conversations using (conv_id, turn)""")
def extracted(spark, sf_dir):
    """First word, number of a worked answer, fenced code and text without any, of every turn."""
    c = table(spark, sf_dir, "conversations")
    worked = F.concat(F.lit("#### "), (F.col("conv_id") * 1000 + F.col("turn")).cast("string"), F.lit(",5 "), "text")
    fenced = F.concat(F.lit("Say\n```python\n"), "text", F.lit("\n```\nend"))
    return c.select("conv_id", "turn", scoring.first_word(F.col("text")).alias("word"), scoring.final_number(worked).alias("number"), F.md5(scoring.code_block(fenced).cast("binary")).alias("code"), F.md5(scoring.code_block(F.col("text")).cast("binary")).alias("plain"))


_LINE = r"regexp_extract(coalesce(predicted, ''), '([^\s](?:[^\n\r\x0b\x0c]*[^\s])?)', 1)"
_NUMBER = r"nullif(replace(regexp_extract({}, '([-+]?[0-9][0-9,]*(?:\.[0-9]+)?)', 1), ',', ''), '')"


@query(f"""with {TURNS}, x as (select *, ['LAMBADA', 'Arithmetic', 'GSM8K', 'TriviaQA'][(conv_id + turn) % 4 + 1] as label, conv_id % 3 as kind, (conv_id * 10 + turn)::varchar as n from turns),
y as (select *, case label when 'LAMBADA' then string_split(text, ' ')[1] when 'Arithmetic' then case kind when 0 then n || '000' else n || ' in all' end when 'GSM8K' then n || '5' else text end as answer,
case label when 'LAMBADA' then case when kind = 0 then string_split(text, ' ')[1] || '. ' || before else before end
 when 'Arithmetic' then case kind when 0 then 'It is ' || n || ',000 or 7' when 1 then 'There are ' || n || '.' else 'nothing' end
 when 'GSM8K' then case kind when 0 then 'So 3 and #### ' || n || ',5' when 1 then n || '5 in all' else n end else case when kind = 0 then ' ' || text || ' and more' else before end end as predicted from x),
z as (select *, {_LINE} as line from y), l as (select *, trim(regexp_extract(line, '^([^\\s]*)', 1), {_quoted(core.ASCII_PUNCTUATION)}) as word, {_NUMBER.format('line')} as number, nullif(trim(replace(regexp_extract(line, '####\\s*(-?[0-9.,]+)', 1), ',', '')), '') as final from z),
m as (select *, case label when 'LAMBADA' then word when 'Arithmetic' then coalesce(number, line) when 'GSM8K' then coalesce(final, number, line) else line end as p, case when label = 'Arithmetic' and number is not null then coalesce({_NUMBER.format('answer')}, answer) else answer end as a from l)
select conv_id, turn, label, {_fold('p')} <> '' and {_fold('a')} <> '' and case when label = 'TriviaQA' or label = 'Arithmetic' and number is null then starts_with({_fold('p')}, {_fold('a')}) else {_fold('p')} = {_fold('a')} end as match from m""")
def task_rules(spark, sf_dir):
    """Matches of made predictions, right and wrong, by the rule of each task: first word, first number, worked answer, prefix of the first line."""
    label = F.element_at(F.array(*map(F.lit, ("LAMBADA", "Arithmetic", "GSM8K", "TriviaQA"))), ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int"))
    t = _turns(spark, sf_dir).withColumn("label", label)
    n, kind, first = (F.col("conv_id") * 10 + F.col("turn")).cast("string"), F.col("conv_id") % 3, F.split("text", " ")[0]
    case = lambda *of: F.when(F.col("label") == "LAMBADA", of[0]).when(F.col("label") == "Arithmetic", of[1]).when(F.col("label") == "GSM8K", of[2]).otherwise(of[3])
    by = lambda *of: F.when(kind == 0, of[0]).when(kind == 1, of[1]).otherwise(of[-1])
    c = lambda *of: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in of))
    text, before = F.col("text"), F.col("before")
    answer = case(first, by(c(n, "000"), c(n, " in all")), c(n, "5"), text)
    predicted = case(by(c(first, ". ", before), before), by(c("It is ", n, ",000 or 7"), c("There are ", n, "."), F.lit("nothing")), by(c("So 3 and #### ", n, ",5"), c(n, "5 in all"), n), by(c(" ", text, " and more"), before))
    return t.select("conv_id", "turn", "label", scoring.task_match(F.col("label"), predicted, F.array(answer)).alias("match"))


@query(f"""with {TURNS}, s as (select *, lag(before) over (partition by conv_id order by turn) as q, lag(text) over (partition by conv_id order by turn) as a from turns)
select conv_id, turn, md5(coalesce(q || ' ' || a || chr(10) || chr(10), '') || before || ' ' || text) as choice, md5(coalesce(q || '. ' || a || chr(10) || chr(10), '') || before || '. ' || text) as schema,
md5(trim(coalesce(trim(q) || ' ' || a || chr(10) || chr(10), '') || trim(before) || ' ', ' ' || chr(9) || chr(10) || chr(13))) as without, md5(coalesce(trim(q) || ' ' || a || chr(10) || chr(10), '') || trim(before) || ' ' || text) as full from s""")
def prompts(spark, sf_dir):
    """Prompts of every turn behind the pair before it, in the templates for choices, contexts and continuations."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = _turns(spark, sf_dir).withColumn("q", F.lag("before").over(w)).withColumn("a", F.lag("text").over(w))
    shot = F.filter(F.array(F.struct(F.col("q").alias("context"), F.col("a").alias("answer"))), lambda s: s["context"].isNotNull())
    made = {
        "choice": sequences.choice_prompt(shot, F.col("before"), F.col("text"), " "),
        "schema": sequences.choice_prompt(shot, F.col("before"), F.col("text"), ". "),
        "without": sequences.continuation_prompts(shot, F.col("before"), F.col("text"), " ")[0],
        "full": sequences.continuation_prompts(shot, F.col("before"), F.col("text"), " ")[1],
    }
    return t.select("conv_id", "turn", *(F.md5(x.cast("binary")).alias(name) for name, x in made.items()))


@query(f"""with {TURNS} select conv_id as key, turn as key2, 'drop' as kind, md5('Passage: ' || trim(before) || chr(10) || chr(10) || 'Question: ' || trim(text) || chr(10) || 'Answer:') as context, role as continuation, 2::bigint as n from turns where trim(role) <> ''
union all select conv_id, turn, 'hops', md5('Passage: ' || role || ': ' || before || ' ' || text || chr(10) || 'b: x' || chr(10) || chr(10) || 'Question: ' || trim(text) || chr(10) || 'Answer:'), trim(role), 1 from turns where trim(role) <> ''
union all select conv_id, turn, 'arithmetic', md5(before), text, 1 from turns union all select conv_id, turn, 'cute', md5(before), text, 1 from turns""")
def task_rows(spark, sf_dir):
    """Turns as rows of published kinds of tasks, brought to (context, continuation, answers)."""
    t = _turns(spark, sf_dir).select(F.col("conv_id").alias("key"), F.col("turn").alias("key2"), "role", "before", "text")
    kinds = {
        "drop": datasets.reading(t.select("key", "key2", F.col("before").alias("passage"), F.col("text").alias("question"), F.array("role", F.lit(" "), F.lit("x")).alias("spans"))),
        "hops": datasets.multi_hop(t.select("key", "key2", F.array("role", F.lit("b"), F.lit("c")).alias("titles"), F.array(F.array("before", "text"), F.array(F.lit("x"))).alias("sentences"), F.col("text").alias("question"), F.col("role").alias("answer"))),
        "arithmetic": datasets.arithmetic(t.select("key", "key2", F.col("before").alias("context"), F.col("text").alias("completion"))),
        "cute": datasets.prompt_answer(t.select("key", "key2", F.col("before").alias("prompt"), F.col("text").alias("answer"))),
    }
    out = None
    for kind, rows in kinds.items():
        one = rows.select("key", "key2", F.lit(kind).alias("kind"), F.md5(F.col("context").cast("binary")).alias("context"), "continuation", F.size("answers").cast("long").alias("n"))
        out = one if out is None else out.union(one)
    return out


@query(f"""with {TURNS} select conv_id, turn, md5(before) as context, case when turn % 3 = 0 then md5(text) else md5('') end as continuation,
case turn % 3 when 0 then [text] when 1 then [text] else [case when turn % 2 = 0 then 'yes' else text end] end as answers from turns where trim(text) <> ''""")
def em_shapes(spark, sf_dir):
    """Rows in the three shapes of an evaluation bundle as (context, continuation, answers)."""
    t = _turns(spark, sf_dir).where(F.trim("text") != "")
    shape, none = F.col("turn") % 3, F.lit(None).cast("string")
    rows = t.select(
        "conv_id", "turn", F.when(shape != 2, F.col("before")).alias("context"), F.when(shape == 0, F.col("text")).alias("continuation"), F.when(shape == 1, F.col("text")).alias("answer"), none.alias("unused"),
        F.when(shape == 2, F.col("before")).alias("query"), F.when(shape == 2, F.array(F.lit("yes"), "text")).alias("choices"), F.when(shape == 2, (F.col("turn") % 2).cast("int")).alias("gold"), F.lit(None).cast("array<string>").alias("answers"),
    )
    e = corpus.em_rows(rows, keep=("conv_id", "turn"))
    return e.select("conv_id", "turn", F.md5(F.col("context").cast("binary")).alias("context"), F.md5(F.col("continuation").cast("binary")).alias("continuation"), "answers")


@query("""with f as (select o_custkey % 40 as folder, o_orderkey % 25 as step, ['model', 'meta', 'optim'][(o_orderkey % 3 + 1)::int] as kind, (o_custkey % 2)::int as rank from orders),
s as (select folder, step, bool_or(kind = 'model') as a, bool_or(kind = 'meta') as b, count(distinct case when kind = 'optim' and rank < 1 then rank end) as n from f group by all),
l as (select folder, max(step) as step from s where a and b and n = 1 group by folder)
select folder, step, step % 2 = 0 as marked from l""")
def latest_checkpoint(spark, sf_dir):
    """The newest complete step of folders of checkpoint files, orders standing in for the files."""
    o = table(spark, sf_dir, "orders")
    f = o.select((F.col("o_custkey") % 40).alias("folder"), (F.col("o_orderkey") % 25).alias("step"), F.element_at(F.array(*map(F.lit, ("model", "meta", "optim"))), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("kind"), (F.col("o_custkey") % 2).cast("int").alias("rank"))
    return evaluation.latest_complete(f, ["folder"], "step", "kind", "rank", 1, f.where("step % 2 = 0").select("folder", "step")).select("folder", "step", "marked")


_KEYED = f"{SURFACES}, b as ({_base_sql('')}), keyed as (select line, {_BASE_KEY} as base_key from b)"


@query(f"with {_KEYED} select base_key, count(distinct line) as n, min(line) as first from keyed where coalesce(base_key, '') <> '' group by base_key having count(distinct line) > 1 order by n desc, base_key limit 50")
def reverse_collisions(spark, sf_dir):
    """The fifty bases that most words of the corpus decompose to."""
    parts = metadata.decomposed(_vocabulary(spark, sf_dir, ""), "id", "surface")
    return metrics.collisions(parts, ["base_key"], "surface", 50).select("base_key", "n", "first")


@query(f"""with {_KEYED}, o as (select base_key, line, first_doc from keyed join surfaces on word = line where coalesce(base_key, '') <> ''), f as (select base_key, arg_min(line, (first_doc, line)) as surface from o group by base_key)
select base_key, surface, sum((line <> surface)::int)::bigint as n_differing from o join f using (base_key) group by base_key, surface""")
def inverse_collisions(spark, sf_dir):
    """Of each base's words the one of the least document, and how many others it stands before."""
    parts = metadata.decomposed(_vocabulary(spark, sf_dir, ""), "id", "surface").join(_surfaces(spark, sf_dir).select(F.col("word").alias("surface"), "first_doc"), "surface")
    return metrics.first_surfaces(parts, ["base_key"], "surface", ["first_doc", "surface"])


@query("""with w as (select doc_id, unnest(string_split(text, ' ')) as w, generate_subscripts(string_split(text, ' '), 1) as pos from documents),
r as (select doc_id, length(w) % 8 as grp, pos, (strlen(w) + pos) % 4 as value from w)
select doc_id, grp, coalesce(arg_max(value, pos) filter (where value <> 0), 0) as value from r group by doc_id, grp""")
def last_values(spark, sf_dir):
    """Of eight groups of modifiers along each document the last value that isn't the default."""
    w = _documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "w"))
    r = w.select("doc_id", (F.length("w") % 8).alias("grp"), "pos", ((F.octet_length("w") + F.col("pos") + 1) % 4).alias("value"))
    return evaluation.last_values(r, ["doc_id"], "grp", "pos", "value")


@query(r"""with w as (select doc_id, unnest(string_split(text, ' ')) as w, generate_subscripts(string_split(text, ' '), 1) as pos from documents),
s as (select doc_id, pos, sum((pos > 1 and w <> '')::int) over (partition by doc_id order by pos) as upto from w)
select doc_id, max(upto)::bigint as n_space, sum(upto)::bigint as total from s group by doc_id""")
def space_prefix_counts(spark, sf_dir):
    """Tokens behind a space up to each token of a document: how many in all, and the sum of the running counts."""
    w = _documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "w"))
    upto = F.sum(((F.col("pos") > 0) & (F.col("w") != "")).cast("int")).over(Window.partitionBy("doc_id").orderBy("pos"))
    return w.select("doc_id", upto.alias("u")).groupBy("doc_id").agg(F.max("u").alias("n_space"), F.sum("u").alias("total"))


@query("""with t as (select conv_id, turn, list_distinct(string_split(text, ' ')) as w from conversations),
o as (select conv_id, turn, list(x order by length(x) desc, x) as w from (select conv_id, turn, unnest(w) as x from t) group by all) select conv_id, turn, md5(array_to_string(w, ' ')) as longest_first from o""")
def longest_first(spark, sf_dir):
    """Distinct words of every turn, the longest first."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(F.split("text", " ")).alias("w"))
    ordered = F.transform(F.array_sort(F.transform("w", lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"])
    return c.select("conv_id", "turn", F.md5(F.array_join(ordered, " ").cast("binary")).alias("longest_first"))


@query(r"""with p as (select doc_id, string_split(text, ' ') as ids from documents), places as (select ids, unnest(range(1, len(ids))) as p from p),
e as (select distinct [ids[p], ids[p + 1]] as r from places)
select count(*) as n_entries, count(*) filter (where len(list_filter(r, lambda w: regexp_matches(w, '[\t\n\x0b\f\r]') and regexp_matches(w, '[^\s]'))) = 0) as n_kept from e""")
def allowed_entries(spark, sf_dir):
    """Pairs of neighbouring tokens of the corpus, and those without a token that mixes line ends with other characters."""
    # Neighbours meet inside their row: an array that is copied to each of its places grows with the square of its length.
    t = spread(_documents(spark, sf_dir).select("text")).select(F.split("text", " ").alias("ids"))
    pairs = F.zip_with(F.slice("ids", F.lit(1), F.size("ids") - 1), F.slice("ids", F.lit(2), F.size("ids")), lambda a, b: F.array(a, b))
    e = Tables(spark, "entries").keep(t.select(F.explode(pairs).alias("token_ids")).distinct(), "pairs")
    kept = metadata.reachable(e, surfaces.mixes_line_space)
    return e.agg(F.count("*").alias("n_entries")).crossJoin(kept.agg(F.count("*").alias("n_kept")))


@query(f"""with {SURFACES}, l as (select word, {_LETTERS.format('word')} as l from surfaces)
select word, l = '' or regexp_full_match(l, '\\p{{Lu}}?\\p{{Ll}}*') as representable, case when l = '' then null else regexp_matches(l[1], '\\p{{Lu}}') end as upper_first,
case when regexp_matches(word[1], '\\p{{Lu}}') then upper('x') || 'yz' else 'xyz' end as like_first,
replace(trim(regexp_replace(regexp_replace(regexp_replace(word, '(\\p{{Ll}})(\\p{{Lu}})', '\\1' || chr(1) || '\\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1' || chr(1) || '\\2', 'g'), chr(1), chr(1), 'g')), chr(1), ' ') as parts from l""")
def word_predicates(spark, sf_dir):
    """Of every word: whether its capitals can be said by a modifier, its first letter's case, another text in that case, and its parts."""
    w = _surfaces(spark, sf_dir).select("word")
    word = F.col("word")
    return w.select("word", surfaces.cap_representable(word).alias("representable"), surfaces.first_letter_upper(word).alias("upper_first"), surfaces.like_first_letter(F.lit("xyz"), word).alias("like_first"), F.trim(F.array_join(affixes.camel_parts(word), " ")).alias("parts"))


@query(f"""with a as ({_strip_sql()}), n as (select line, [case when space_prefix then 'with_space_prefix' else 'no_space_prefix' end, case {_STATE} when 'first_cap' then 'add_base_capitalization' when 'all_caps' then 'add_all_caps_base_capitalization' else 'no_base_capitalization' end,
coalesce('article_' || article, 'no_article'), case when article_cap then 'add_article_capitalization' else 'no_article_capitalization' end, coalesce('prep_' || prep, 'no_preposition'), case when prep_cap then 'add_prep_capitalization' else 'no_prep_capitalization' end,
coalesce('prefix_punct_' || prefix_punct, 'no_prefix_punctuation'), coalesce('suffix_punct_' || suffix_punct, 'no_suffix_punctuation')] as names from a)
select line, array_to_string(names, '|') as names, list_has_any(names, [{', '.join(map(_quoted, surfaces.ACTIVE_TRANSFORMS))}]) as active from n""")
def transform_names(spark, sf_dir):
    """One transformation name of every group for each distinct line, and whether one changes space or capitals."""
    a = affixes.strip_affixes(_lines(spark, sf_dir), "line").withColumn("capitalization", affixes.capitalization(F.col("base")))
    kinds = ("space_prefix", "capitalization", "article", "article_cap", "prep", "prep_cap", "prefix_punct", "suffix_punct")
    n = a.select(F.md5(F.col("line").cast("binary")).alias("line"), surfaces.complete_transforms({k: F.col(k) for k in kinds}).alias("names"))
    return n.select("line", F.array_join("names", "|").alias("names"), surfaces.any_active(F.col("names")).alias("active"))


SIZES = [3, 4, 11, 2]


@query("""with w as (select distinct length(unnest(string_split(text, ' '))) as n from documents), r as (select n, [n % 3, n % 4, n % 11, n % 2] as row from w),
g as (select n, row, [row[1], row[2] + 3, row[3] + 7, row[4] + 18] as places from r)
select n, places, list_transform(range(0, 20), lambda i: list_contains(places, i)::int) as hot, row from g""")
def modifier_indices(spark, sf_dir):
    """Rows of values within groups, their places among all values, those as 0 and 1, and the way back."""
    w = _documents(spark, sf_dir).select(F.explode(F.transform(F.split("text", " "), lambda x: F.length(x))).alias("n")).distinct()
    r = w.select("n", F.array(*(F.col("n") % s for s in SIZES)).alias("row"))
    places = surfaces.global_indices(F.col("row"), SIZES)
    return r.select("n", places.alias("places"), surfaces.one_hot(F.col("row"), SIZES).alias("hot"), surfaces.relative_row(places, SIZES).alias("row"))


@query("""with w as (select distinct length(unnest(string_split(text, ' '))) as m from documents), r as (select m, [m % 3, m % 4, m % 11, m % 2] as row, m % 5 as n from w)
select m, case when n <= 1 then [row] else list_transform(range(1, n + 1), lambda i: case when i = 1 then [row[1], 0, row[3], 0] when i = n then [0, row[2], 0, row[4]] else [0, 0, 0, 0] end) end as rows from r""")
def spread_rows(spark, sf_dir):
    """Modifier rows over bases of several tokens: some groups on the first, the rest on the last."""
    w = _documents(spark, sf_dir).select(F.explode(F.transform(F.split("text", " "), lambda x: F.length(x))).alias("m")).distinct()
    row = F.array(*(F.col("m") % s for s in SIZES))
    return w.select("m", sequences.spread(row, F.col("m") % 5, [0, 2]).alias("rows"))


@query(f"""with {SURFACES}, t as (select word, word || ' ' as k from surfaces), c as (select word, [word, lower(word), regexp_replace(lower(word), '[.,;:!?]$', ''), '?'] as c from t), base as (select distinct word as b from surfaces where n >= 3),
e as (select word, unnest(c) as x, generate_subscripts(c, 1) - 1 as rank from c), h as (select word, min(rank) as rank, arg_min(x, rank) as hit from e join base on x = b group by word)
select word, rank, hit from surfaces left join h using (word)""")
def base_probe(spark, sf_dir):
    """Of each word's candidate bases in order the first that occurs three times."""
    s = _surfaces(spark, sf_dir)
    word = F.col("word")
    c = F.array(word, F.lower(word), F.regexp_replace(F.lower(word), "[.,;:!?]$", ""), F.lit("?"))
    return evaluation.first_hit(s.select("word"), "word", c, s.where("n >= 3"), "word")


@query(f"""with {_KEYED}, o as (select line as variant, min(base_key) as owner from keyed where coalesce(base_key, '') <> '' and length(base_key) > 3 group by line)
select word as variant, coalesce(owner, word) as owner from surfaces left join o on word = variant""")
def variant_owners(spark, sf_dir):
    """The base that owns each word; a word whose base has three characters or fewer owns itself."""
    parts = metadata.decomposed(_vocabulary(spark, sf_dir, ""), "id", "surface").where(F.length("base_key") > 3)
    owners = parts.select(F.col("surface").alias("variant"), F.col("base_key").alias("owner"))
    return evaluation.with_owner(_surfaces(spark, sf_dir).select(F.col("word").alias("variant")), owners, "variant", "owner")


def _profile_sql(words: str) -> str:
    return "case " + " ".join(f"when {words} = list_sort([{', '.join(map(_quoted, x))}]) then '{n}'" for n, x in PREPOSITIONS.items()) + " else 'custom' end"


@query(f"""with {SURFACES}, k(kind, word) as (values {", ".join(f"('{n}', {_quoted(w)})" for n, x in PREPOSITIONS.items() for w in x)}),
s as (select word, d.lang from (select distinct lower(w) as word, doc_id from (select doc_id, unnest(string_split_regex(text, '[ \\n]+')) as w from documents)) o join documents d using (doc_id)),
g as (select coalesce(lang, 'und') as lang, kind, list_sort(list(distinct word)) as w from s join k using (word) group by all)
select lang, kind, {_profile_sql('w')} as profile, len(w) as n from g union all select 'all', kind, {_profile_sql('w')}, len(w) from (select kind, list_sort(list(distinct word)) as w from s join k using (word) group by kind)""")
def preposition_profiles(spark, sf_dir):
    """The profile that each profile's words are which a language's documents use, and those of all documents."""
    known = spark.createDataFrame([(n, w) for n, x in PREPOSITIONS.items() for w in x], "kind string, word string")
    used = _documents(spark, sf_dir).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(F.lower("text"), "[ \n]+")).alias("word"))
    used = used.join(F.broadcast(known), "word").select("kind", F.explode(F.array("lang", F.lit("all"))).alias("lang"), F.concat(F.lit(" "), F.upper("word")).alias("word"))
    words = surfaces.normalized_list(F.array_sort(F.collect_set("word")))
    lists = used.groupBy("lang", "kind").agg(words.alias("words"))
    return lists.select("lang", "kind", surfaces.preposition_profile(F.col("words")).alias("profile"), F.size("words").cast("long").alias("n"))


@query("""with c as (select doc_id, source, lang from documents), asked(pos, source) as (select row_number() over (order by length(source), source) - 1, source from (select distinct source from documents where source is not null))
select pos, lower(a.source) as source, count(*) as n from asked a join c on lower(c.source) = lower(a.source) where c.lang <> 'de' and pos <> 2 group by all""")
def chosen_sources(spark, sf_dir):
    """Documents of the sources that are asked for, whatever the case, without the third, and of all languages but one."""
    d = _documents(spark, sf_dir)
    sources = d.where("source is not null").select(F.col("source").alias("name")).distinct()
    asked = preparation.renumbered(sources.withColumn("size", F.length("name")), ["size", "name"], "pos").select("pos", F.upper("name").alias("name"))
    chosen = preparation.requested(sources, asked, "name", asked.where("pos = 2"))
    hit = d.where("lang <> 'de'").join(chosen, F.lower("source") == F.lower("name"))
    return hit.groupBy("pos", F.lower("source").alias("source")).agg(F.count("*").alias("n"))


@query(f"""with {SURFACES} select word, 4 * (word <> '')::int as groups, strlen(word)::bigint as plain, strlen(' the ' || word || '.')::bigint as dressed from surfaces""")
def surface_bytes(spark, sf_dir):
    """Bytes of every word plain and with a space, a determiner and a full stop, from the bytes that its modifiers add."""
    row = F.array(F.lit(1), F.lit(0), F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(metadata.GROUPS[7][1].index(".")))
    w = _surfaces(spark, sf_dir)
    return w.select("word", F.size(F.filter(row, lambda v: v > 0)).alias("groups") + 1, F.octet_length("word").cast("long").alias("plain"), (F.octet_length("word") + metadata.utf8_delta(row)).cast("long").alias("dressed")).toDF("word", "groups", "plain", "dressed")


@query(f"""with {SURFACES}, b as (select ('0x' || unnest(regexp_extract_all(hex(encode(word)), '..')))::bigint as byte, n from surfaces)
select byte, case when byte between 33 and 126 or byte between 161 and 172 or byte >= 174 then chr(byte::int)
else chr((256 + (select count(*) from range(256) r(x) where x < byte and not (x between 33 and 126 or x between 161 and 172 or x >= 174)))::int) end as shown, sum(n)::bigint as n from b group by byte""")
def byte_alphabet(spark, sf_dir):
    """The printable stand-ins of the bytes of all words, with how often each occurs."""
    shown = spark.createDataFrame(sorted(metadata.byte_alphabet().items()), "byte long, shown string")
    each = F.expr("transform(sequence(1, octet_length(word)), i -> cast(conv(substring(hex(word), 2 * i - 1, 2), 16, 10) as long))")
    used = _surfaces(spark, sf_dir).select(F.explode(each).alias("byte"), "n").groupBy("byte").agg(F.sum("n").alias("n"))
    return used.join(F.broadcast(shown), "byte").select("byte", "shown", "n")


@query("""with m as (select doc_id, length(text) as n, row_number() over (order by doc_id) - 1 as step from documents)
select round(sum(0.1 * n * pow(0.9::double, (select max(step) from m) - step)) / (1 - pow(0.9::double, (select max(step) + 1 from m))), 4) as ema from m""")
def debiased_average(spark, sf_dir):
    """Exponential mean of the documents' lengths in the order of their ids, freed of its start."""
    d = _documents(spark, sf_dir).select(F.col("doc_id").alias("step"), F.length("text").cast("double").alias("value"))
    return metrics.debiased_average(d, "step", "value").select(F.round("ema", 4).alias("ema"))
