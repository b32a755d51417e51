"""Language of texts by a Viterbi path over the scores of their words.

Learnt: how often each language uses a script, and Laplace-smoothed counts of character trigrams of its words, from
a bounded sample. A word's script narrows the candidates to the languages that use it; its score for each of those
is the mean log-probability of its trigrams. A path through the words that pays `PENALTY` for each change of language
labels spans of mixed texts; the language of most letters on the path is the text's.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Log-probability that a change of language costs.
PENALTY = 4.0
#: Weight of a word: trigrams beyond this many count no further.
LONG = 8
#: Words that a worker remembers.
REMEMBERED = 300_000
#: Texts whose paths are computed side by side, and most words of them all.
TOGETHER, WORDS = 512, 300_000
#: First code point of each range and its script.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x31350, "other"),
)
_STARTS = [a for a, _ in SCRIPTS]
#: Letters by Unicode category, with the marks that follow them; superscripts, fractions and numerals are none.
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def script_of(word: str) -> str:
    """Script of the first letter."""
    return SCRIPTS[bisect.bisect_right(_STARTS, ord(word[0])) - 1][1]


def trigrams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + 3] for i in range(len(w) - 2)]


class Model:
    """Trigram scores of each language; its size is bounded by the sample that it is learnt from."""

    def __init__(self, langs: list[str], grams: dict[str, int], scores: np.ndarray, scripts: dict[str, np.ndarray]):
        self.langs, self.grams, self.scores, self.scripts = langs, grams, scores, scripts
        self._forget()

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("langs", "grams", "scores", "scripts")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, int] = {}
        self._cores: dict[str, int] = {}
        self._table = np.zeros((1 << 12, len(self.langs) + 1), np.float32)
        #: Only scripts that some language doesn't use rule anything out.
        self._ruling = {k: v for k, v in self.scripts.items() if not v.all()}

    def _learn(self, words: list[str]) -> None:
        """Rows of new words: a score for each language, 0 without letters; last, the number of letters.

        Words of the same letters in lower case share a row.
        """
        cores, get = self._cores, self.grams.get
        base = len(cores)
        at, gram, size, weight, letters, ruled = [], [], [], [], [], []
        for word in words:
            parts = _LETTERS.findall(word.lower())
            core = parts[0] if len(parts) == 1 else " ".join(parts)
            row = cores.get(core)
            if row is None:
                row = cores[core] = base + len(letters)
                letters.append(sum(map(len, parts)))
                for own in parts:
                    g = f" {own} "
                    n = len(own)
                    gram += [get(g[i : i + 3], -1) for i in range(n)]
                    at.append(row - base)
                    size.append(n)
                    weight.append(min(n, LONG) / n)
                    if self._ruling and (allowed := self._ruling.get(script_of(own))) is not None:
                        ruled.append((row - base, allowed))
            self._known[word] = row
        out = np.zeros((len(letters), len(self.langs) + 1), np.float32)
        if at:
            each = np.add.reduceat(self.scores[gram], np.cumsum([0, *size[:-1]])) * np.array(weight)[:, None]
            np.add.at(out[:, :-1], np.array(at), each)
        for row, allowed in ruled:
            out[row, :-1] -= np.where(allowed, 0.0, 50.0)
        out[:, -1] = letters
        while base + len(out) > len(self._table):
            self._table = np.concatenate([self._table, np.zeros_like(self._table)])
        self._table[base : base + len(out)] = out

    def rows(self, words: list[list[str]]) -> list[np.ndarray]:
        """For each list of words, a row per word: a score for each language and the number of letters."""
        if len(self._known) > REMEMBERED:
            self._forget()
        new: set[str] = set()
        for w in words:
            new.update(w)
        new.difference_update(self._known)
        if new:
            self._learn(list(new))
        known = self._known.__getitem__
        return [self._table[np.fromiter(map(known, w), np.int32, len(w))] for w in words]


def all_one(scores: np.ndarray, penalty: float = PENALTY) -> int | None:
    """The language that a text's whole best path has, if that is plain, else None.

    A detour to other languages pays at least one penalty for each stretch of one language in it: no detour pays if
    no stretch anywhere gains more than that over the language of greatest sum. A path that never takes that language
    pays one penalty less than it has stretches; its first stretch begins the text and its last one ends it, so what
    those two gain together must not be more than a penalty either.
    """
    best = int(scores.sum(0).argmax())
    gain = np.zeros((len(scores) + 1, scores.shape[1]))
    np.cumsum(scores - scores[:, best : best + 1], axis=0, dtype=np.float64, out=gain[1:])
    if (gain[1:] - np.minimum.accumulate(gain)[:-1]).max() > penalty:
        return None
    return best if gain[1:].max() + (gain[-1] - gain[:-1]).max() <= penalty else None


def paths(scores: list[np.ndarray], penalty: float = PENALTY) -> list[np.ndarray]:
    """Best language of every word of each text. Texts run side by side, the longest first, each as long as it lasts."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order])
    n, langs = (int(sizes[0]) if len(sizes) else 0), scores[0].shape[1] if scores else 0
    live = np.searchsorted(-sizes, -np.arange(1, n + 1), "right")  # texts with at least t + 1 words
    starts = np.concatenate([[0], np.cumsum(live)])
    table = np.empty((starts[-1], langs), np.float32)  # all words, by place and then by text
    for k, i in enumerate(order):
        table[starts[: sizes[k]] + k] = scores[i]
    back = np.empty((starts[-1], langs), np.int32)
    ends = np.empty(len(order), np.int32)
    value = np.zeros((len(order), langs), np.float32)
    own = np.arange(langs, dtype=np.int32)
    for t in range(n):
        m = live[t]
        if t:
            if m < live[t - 1]:
                ends[m : live[t - 1]] = value[m : live[t - 1]].argmax(1)
            v = value[:m]
            top = v.argmax(1)
            most = v[np.arange(m), top] - penalty
            change = most[:, None] > v
            back[starts[t] : starts[t + 1]] = np.where(change, top[:, None].astype(np.int32), own)
            value[:m] = np.where(change, most[:, None], v) + table[starts[t] : starts[t + 1]]
        else:
            value[:m] = table[:m]
    if n:
        ends[: live[n - 1]] = value[: live[n - 1]].argmax(1)
    path = np.empty(starts[-1], np.int32)
    for t in range(n - 1, -1, -1):
        m, later = live[t], live[t + 1] if t + 1 < n else 0
        here = ends[:m].copy()
        if later:
            here[:later] = back[starts[t + 1] : starts[t + 2]][np.arange(later), path[starts[t + 1] : starts[t + 2]]]
        path[starts[t] : starts[t + 1]] = here
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(scores)
    for k, i in enumerate(order):
        out[i] = path[starts[: sizes[k]] + k]
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _counter(batches):
    """(lang, kind, key, n): trigrams and scripts of the words of whole texts, added up within a batch."""
    names = ["lang", "kind", "key", "n"]
    for b in batches:
        for i in range(0, b.num_rows, 64):
            tri: Counter = Counter()
            use: Counter = Counter()
            for lang, text in zip(b.column(0).slice(i, 64).to_pylist(), b.column(1).slice(i, 64).to_pylist()):
                for w, n in Counter(_LETTERS.findall(text.lower())).items():
                    use[lang, script_of(w)] += n
                    for g in trigrams(w):
                        tri[lang, g] += n
            rows = [(lang, kind, key, n) for kind, c in (("gram", tri), ("script", use)) for (lang, key), n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], names=names)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400) -> Model:
    """Learn every language from the whole texts of at most `per_lang` of its ids, the first by a hash of the id.

    Held-out ids, null ids, texts and languages are left out. The texts are counted on the executors; only the ids
    (1.5 * `per_lang` a language, about) and the counts of the trigrams come to the driver, not the texts: rows that
    repeat an id all count, wherever they are. With nothing to learn from, the model knows no language.
    """
    seen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    seen = seen.where("text is not null and lang is not null and id is not null").where(~held_out(F.col("id")))
    counts = {r["lang"]: r["n"] for r in seen.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    tri: dict[str, Counter] = {x: Counter() for x in langs}
    use: dict[str, Counter] = {x: Counter() for x in langs}
    if counts:
        spark = docs.sparkSession
        # A share of the hash range a little above what is needed, exact where there are no more rows than that.
        share = spark.createDataFrame([(k, int(min(1.0, 1.5 * per_lang / n) * 2**20)) for k, n in counts.items()], "lang string, share int")
        key = F.pmod(F.xxhash64("id"), F.lit(2**20))
        ids = seen.select("lang", "id", key.alias("key")).join(F.broadcast(share), "lang").where("key <= share").groupBy("lang", "id").agg(F.min("key").alias("key"))
        rank = F.row_number().over(Window.partitionBy("lang").orderBy("key", "id"))
        ids = ids.withColumn("rank", rank).where(F.col("rank") <= per_lang).select(F.col("lang").alias("l"), F.col("id").alias("i"))
        chosen = seen.join(F.broadcast(ids), (F.col("lang") == F.col("l")) & (F.col("id") == F.col("i")), "left_semi")
        found = chosen.select("lang", "text").mapInArrow(_counter, "lang string, kind string, key string, n long")
        for r in found.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).toLocalIterator():
            (tri if r["kind"] == "gram" else use)[r["lang"]][r["key"]] = r["n"]
    kinds = sorted({g for c in tri.values() for g in c})
    total = np.array([sum(tri[x].values()) for x in langs], float)
    smooth = 0.5
    bottom = np.log(total + smooth * (len(kinds) + 1)) if langs else np.zeros(0)
    grams = {g: k for k, g in enumerate(kinds)}
    # The last row serves trigrams that no language has.
    table = np.full((len(kinds) + 1, len(langs)), smooth)
    for k, x in enumerate(langs):
        table[[grams[g] for g in tri[x]], k] += list(tri[x].values())
    scripts = {s: np.array([use[x][s] > 0.001 * max(1, sum(use[x].values())) for x in langs]) for s in {s for c in use.values() for s in c}}
    return Model(langs, grams, np.log(table) - bottom, {s: v for s, v in scripts.items() if v.any()})


def label(texts: list[str | None], model: Model, with_spans: bool = False) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, score, spans) of each text; spans are (start, end, language) in code points, one per run of words.

    Words are runs without white space; the letters in them score, and what has no letter goes with its neighbours.
    """
    out: list = [("und", 0.0, [])] * len(texts)
    if not model.langs:
        return out
    words = [(t or "").split() for t in texts]
    rows = model.rows(words)
    some = [i for i, r in enumerate(rows) if len(r) and r[:, -1].any()]
    path: dict[int, np.ndarray | int] = {i: all_one(rows[i][:, :-1]) for i in some}
    mixed = [i for i in some if path[i] is None]
    path.update(zip(mixed, paths([rows[i][:, :-1] for i in mixed])))
    for i in some:
        own, letters = path[i], rows[i][:, -1].astype(float)
        if isinstance(own, int):
            best, share, own = own, 1.0, np.full(1, own) if not with_spans else np.full(len(letters), own)
        else:
            shares = np.bincount(own, weights=letters, minlength=len(model.langs)) / letters.sum()
            best, share = int(shares.argmax()), float(shares.max())
        spans = []
        if with_spans:
            at = [m.span() for m in re.finditer(r"\S+", texts[i])]
            cuts = np.flatnonzero(np.diff(own)) + 1
            spans = [(at[a][0], at[b - 1][1], model.langs[own[a]]) for a, b in zip([0, *cuts], [*cuts, len(own)])]
        out[i] = (model.langs[best], share, spans)
    return out


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """A row per row of `docs`: doc_id, lang_pred, score - the share of letters in that language - and, if asked, spans.

    `und` and 0 for a text that is null or has no letter (by Unicode category), or if the model knows no language. A
    tie goes to the language that sorts first. Each row stands for itself: a null doc_id stays null, rows that repeat
    one give a row each; an empty table gives none, and columns of whatever other names are not read.
    """

    def run(batches):
        for b in batches:
            texts = b.column(1)
            i = 0
            while i < b.num_rows:
                own, size = [], 0
                while i < b.num_rows and len(own) < TOGETHER and (not own or size < 6 * WORDS):
                    own.append(texts[i].as_py())
                    size += len(own[-1] or "")
                    i += 1
                got = label(own, model, with_spans)
                columns = [b.column(0).slice(i - len(own), len(own)), pa.array([x for x, _, _ in got], pa.string()), pa.array([x for _, x, _ in got], pa.float64())]
                names = ["doc_id", "lang_pred", "score"]
                if with_spans:
                    columns.append(pa.array([[{"start": s, "end": e, "lang": x} for s, e, x in spans] for _, _, spans in got], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<start: long, end: long, lang: string>>" * with_spans
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
