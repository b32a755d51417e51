"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give the base spans. Round the digits, at-signs and key-like words that they leave over, a semi-Markov
field scores whole candidate segments - how many digits, which separators, whether a checksum holds, which word
stands before - together with the change from the label before, and a dynamic program over boundaries and types,
with entities of at most `LONGEST` tokens, picks the best segmentation jointly. The weights maximise the conditional
likelihood of the segmentations of written-out examples: the gradient is what the gold segmentation has of each
feature less what the field expects, from sums over all segmentations, forward and backward.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: What the field labels: the same kinds, and two that have no base pattern.
LABELS = (*KINDS, "ssn", "secret")
#: Most tokens of an entity.
LONGEST = 16
#: Code points on each side of a digit or at-sign that the field looks at.
ROUND = 40

# The base patterns.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9]+|@|[\[(]\s*at\s*[\])]")
_TOKEN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}(?![A-Za-z0-9])|[^\W\d_]+|[0-9]+|\s+|.", re.S)
_CUES = {
    **dict.fromkeys(("tel", "phone", "call", "fax", "mobile", "cell", "telefon", "appelez"), "phone"),
    **dict.fromkeys(("card", "visa", "mastercard", "credit", "karte", "tarjeta", "carte"), "card"),
    **dict.fromkeys(("ip", "host", "server", "address", "ipv4"), "ip"),
    **dict.fromkeys(("mail", "email", "contact", "write", "correo", "courriel"), "email"),
    **dict.fromkeys(("ssn", "social", "security"), "ssn"),
    **dict.fromkeys(("token", "key", "secret", "password", "passwd", "apikey"), "secret"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns' spans: leftmost, not overlapping within a kind, failing matches dropped without a retry."""
    out = []
    end = seen = 0
    at = text.find("@")
    while at >= 0:
        if at >= end:
            low = max(end, seen)
            run = text[low:at]
            start = low + len(run.rstrip(_LOCAL))
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                out.append(("email", start, m.end()))
                end = m.end()
        seen = at + 1
        at = text.find("@", at + 1)
    if re.search("[0-9]", text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


#: Features whose values of a whole segment are read off the segment alone.
_OBSCURED = re.compile(r"[\[(]\s*at\s*[\])]")
_DOT = re.compile(r"(\.|[\[(]\s*dot\s*[\])])\s*[A-Za-z]{2,}$")
_BLANKS = re.compile(r"\s*[\[(]\s*(at|dot)\s*[\])]\s*")
_KEYLIKE = re.compile(r"[A-Za-z0-9_+/=-]{20,}")


def _features(s: str, cue: str, right: str) -> list[str]:
    """Of the whole segment s, the word before it and the character after it."""
    d = _digits(s)
    n = len(d)
    letters = any(c.isalpha() for c in s)
    groups = re.findall("[0-9]+", s)
    marks = "".join(sorted({c for c in s if not c.isalnum()}))
    out = ["bias", f"letters={letters}", f"marks={marks}/{letters}", f"first={'d' if '0' <= s[0] <= '9' else 'a' if s[0].isalpha() else s[0]}"]
    if _KEYLIKE.fullmatch(s):
        hexa = all(c in "0123456789abcdefABCDEF" for c in s)
        out += ["keylike", f"hex={hexa}", f"long={min(len(s) // 8, 8)}", f"mixed={0 < n < len(s)}"]
    elif letters:
        obscured = bool(_OBSCURED.search(s))
        words = re.findall(r"[^\W\d_]+", s)
        out += [f"at={s.count('@') == 1 or obscured}", f"dot={bool(_DOT.search(s))}", f"blank={' ' in _BLANKS.sub('', s)}", f"words={min(len(words), 6)}"]
    else:
        out += [f"digits={min(n, 20)}", f"groups={min(len(groups), 6)}", f"shape={'-'.join(str(len(g)) for g in groups[:5])}/{marks}", f"luhn={16 <= n <= 19 and luhn(d)}", f"octets={len(groups) == 4 and all(int(g) <= 255 for g in groups if len(g) < 4)}"]
    return [*out, f"cue={cue}", f"edge={right.isalnum() or right in '@='}", f"solid={not marks and not letters}"]


def _segments(tokens: list[str], barred: list[bool]) -> list[list[tuple[int, list[str]]]]:
    """For each end, the (start, features) of the candidate segments that end there.

    A candidate starts and ends with a letter or digit (or starts with + or an opening bracket), stays in its line,
    and has seven digits and no letters, or an at-sign, plain or written out, or is one long key-like word. What rules
    a start or its longer segments out is seen from counts, before any feature is made.
    """
    cues, word = [], ""
    for t in tokens:
        cues.append(_CUES.get(word, "-"))
        if t.isalpha():
            word = t.lower()
        elif "\n" in t:
            word = ""
    digits = [len(t) if t.isdecimal() and t.isascii() else 0 for t in tokens]
    out: list[list[tuple[int, list[str]]]] = [[] for _ in range(len(tokens) + 1)]
    for i, t in enumerate(tokens):
        if barred[i] or not (t[0].isalnum() or t in "+("):
            continue
        if i and (tokens[i - 1].isalnum() or tokens[i - 1] in ("@", ".", "_", "-", "+")) and t.isalnum():
            continue
        n = size = 0
        letters = at = key = False
        for j in range(i + 1, min(i + LONGEST, len(tokens)) + 1):
            u = tokens[j - 1]
            if barred[j - 1] or "\n" in u:
                break
            n += digits[j - 1]
            size += len(u)
            letters = letters or not digits[j - 1] and u[0].isalnum() and any(c.isalpha() for c in u)
            at = at or u in ("@", "at")
            if not u[-1].isalnum() or len(tokens) > j and tokens[j].isalnum() and u.isalnum():
                continue
            key = letters and not at and size >= 20
            if not (key or (at if letters else n >= 7)):
                continue
            s = "".join(tokens[i:j])
            if key and not _KEYLIKE.fullmatch(s) or letters and not key and "@" not in s and not _OBSCURED.search(s):
                continue
            out[j].append((i, _features(s, cues[i], tokens[j][0] if j < len(tokens) else " ")))
    return out


class Field:
    """Weights of segment features by label, and of the label (or none, 0) that a token or segment follows."""

    def __init__(self):
        self.names: dict[str, int] = {}
        self.w = np.zeros((0, len(LABELS)))
        self.t = np.zeros((len(LABELS) + 1, len(LABELS) + 1))

    def score(self, features: list[str]) -> np.ndarray:
        """Of each label for a segment."""
        return self.w[[k for x in features if (k := self.names.get(x)) is not None]].sum(0)

    def best(self, segments: list[list[tuple[int, list[str]]]]) -> list[tuple[int, int, str]]:
        """Viterbi over segmentations, with the label before: (start, end, label) of the entities."""
        n = len(segments) - 1
        if not any(segments):
            return []
        value = np.full((n + 1, len(LABELS) + 1), -np.inf)
        value[0, 0] = 0.0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        out_of: dict[int, int] = {}
        for j in range(1, n + 1):
            before = value[j - 1] + self.t[:, 0]
            out_of[j] = int(before.argmax())
            value[j, 0] = before[out_of[j]]
            for i, f in segments[j]:
                came = value[i][:, None] + self.t[:, 1:]
                top = came.argmax(0)
                got = came[top, np.arange(len(LABELS))] + self.score(f)
                for y in np.flatnonzero(got > value[j, 1:]):
                    value[j, y + 1] = got[y]
                    back[j, int(y) + 1] = (i, int(top[y]))
        out, j, y = [], n, int(value[n].argmax())
        while j:
            if y:
                i, before_y = back[j, y]
                out.append((i, j, LABELS[y - 1]))
                j, y = i, before_y
            else:
                y = out_of[j]
                j -= 1
        return out[::-1]

    def log_likelihood(self, segments, gold: list[tuple[int, int, str]]) -> tuple[float, list[tuple[list[str], np.ndarray]], np.ndarray]:
        """Of the gold segmentation, and its gradient: (features, by label) of segments, and of the label changes."""
        n, m = len(segments) - 1, len(LABELS) + 1
        scores = {(i, j): self.score(f) for j in range(1, n + 1) for i, f in segments[j]}
        a, b = np.full((n + 1, m), -np.inf), np.full((n + 1, m), -np.inf)
        a[0, 0] = 0.0
        b[n] = 0.0
        add = lambda x: np.logaddexp.reduce(x, axis=0)
        for j in range(1, n + 1):
            a[j, 0] = add(a[j - 1] + self.t[:, 0])
            for i, _ in segments[j]:
                a[j, 1:] = np.logaddexp(a[j, 1:], add(a[i][:, None] + self.t[:, 1:]) + scores[i, j])
        z = float(add(a[n]))
        ends = defaultdict(list)
        for i, j in scores:
            ends[i].append(j)
        grad_t = np.zeros((m, m))
        rows = []
        chosen = {(i, j): LABELS.index(k) for i, j, k in gold}
        features = {(i, j): f for j in range(1, n + 1) for i, f in segments[j]}
        for i in range(n - 1, -1, -1):
            step = self.t[:, 0] + b[i + 1, 0]
            grad_t[:, 0] -= np.exp(np.minimum(a[i] + step - z, 0.0))
            b[i] = step
            for j in ends[i]:
                move = self.t[:, 1:] + scores[i, j] + b[j, 1:]
                b[i] = np.logaddexp(b[i], add(move.T))
                p = np.exp(np.minimum(a[i][:, None] + move - z, 0.0))
                grad_t[:, 1:] -= p
                g = -p.sum(0)
                if (i, j) in chosen:
                    g[chosen[i, j]] += 1
                rows.append((features[i, j], g))
        value, y, at = 0.0, 0, 0
        for i, j, k in [*gold, (n, n, None)]:
            while at < i:
                value += self.t[y, 0]
                grad_t[y, 0] += 1
                y, at = 0, at + 1
            if k:
                v = LABELS.index(k) + 1
                value += self.t[y, v] + scores[i, j][v - 1]
                grad_t[y, v] += 1
                y, at = v, j
        return value - z, rows, grad_t


def _examples(n: int, rng: random.Random) -> list[list[tuple[str, str | None]]]:
    """Written-out sentences as (text, kind or None) pieces."""
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(3, 8)))

    def card(sep: str) -> str:
        body = d(15)
        return sep.join(re.findall("....", body + next(c for c in "0123456789" if luhn(body + c))))

    yes = {
        "email": [lambda: f"{name()} [at] {name()}.com", lambda: f"{name()}.{name()} (at) {name()} (dot) org", lambda: f"{name()} @ {name()}.net", lambda: f"{name()}{d(2)}[at]{name()}[dot]de"],
        "ip": [lambda: " . ".join(str(rng.randint(1, 255)) for _ in range(4)), lambda: "[.]".join(str(rng.randint(1, 255)) for _ in range(4))],
        "card": [lambda: card("."), lambda: card("/"), lambda: card(" - ")],
        "ssn": [lambda: f"{rng.randint(1, 8)}{d(2)}-{d(2)}-{d(4)}", lambda: f"{rng.randint(1, 8)}{d(2)} {d(2)} {d(4)}"],
        "secret": [lambda: hashlib.sha1(d(9).encode()).hexdigest(), lambda: hashlib.sha1(d(9).encode()).hexdigest().upper(), lambda: "sk_live_" + hashlib.md5(d(9).encode()).hexdigest()[:24], lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), lambda: "ghp_" + hashlib.sha256(d(9).encode()).hexdigest()[:36]],
        "phone": [lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"00{d(2)} {d(3)} {d(7)}", lambda: f"1 ({d(3)}) {d(3)}-{d(4)}"],
    }
    no = [lambda: d(16), lambda: d(8), lambda: d(10), lambda: d(13), lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"{d(1)}.{d(1)}.{d(2)}", lambda: f"{d(3)},{d(3)},{d(3)}", lambda: f"{d(4)}", lambda: name() * 6, lambda: "=" * 24, lambda: "-".join(name() for _ in range(6)), lambda: f"{name()}_{name()}_{name()}_{name()}_{d(2)}",
          lambda: f"{d(2)}:{d(2)}:{d(2)} {d(2)}/{d(2)}/{d(4)}", lambda: f"isbn {d(3)}-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"{d(3)}.{d(3)}.{d(3)}.{d(3)}.{d(3)}", lambda: f"@{name()}", lambda: f"{d(2)} {d(3)} {d(3)} {d(4)}", lambda: f"{d(4)}.{d(3)}.{d(5)}.{d(4)}", lambda: f"version {d(1)}.{d(1)}"]
    cues = defaultdict(list)
    for w, k in _CUES.items():
        cues[k].append(w)
    out = []
    for _ in range(n):
        row: list[tuple[str, str | None]] = []
        for _ in range(rng.randint(1, 3)):
            row.append((" ".join(name() for _ in range(rng.randint(1, 4))) + " ", None))
            if rng.random() < 0.5:
                kind = rng.choice(LABELS)
                quote = '"' if kind == "secret" and rng.random() < 0.6 else ""
                if rng.random() < 0.5 or kind == "ssn" and rng.random() < 0.5:
                    row.append((rng.choice(cues[kind]) + rng.choice((" = ", ": ") if quote else (" ", ": ")) + quote, None))
                row.append((rng.choice(yes[kind])(), kind))
                if quote:
                    row.append((quote, None))
            else:
                row.append((rng.choice(no)(), None))
            row.append((rng.choice((" ", ". ", ", ", "\n")), None))
        out.append(row)
    return out


@functools.cache
def trained(examples: int = 400, passes: int = 8, seed: int = 5, rate: float = 0.3, ridge: float = 1e-3) -> Field:
    """The field of greatest penalised likelihood that AdaGrad steps over the examples reach; the same in every process."""
    rng = random.Random(seed)
    data, field = [], Field()
    for row in _examples(examples, rng):
        tokens, gold = [], []
        for text, kind in row:
            own = _TOKEN.findall(text)
            if kind:
                gold.append((len(tokens), len(tokens) + len(own), kind))
            tokens += own
        segments = _segments(tokens, [False] * len(tokens))
        known = {(i, j) for j, s in enumerate(segments) for i, _ in s}
        for _, f in (x for s in segments for x in s):
            for name in f:
                field.names.setdefault(name, len(field.names))
        data.append((segments, [g for g in gold if g[:2] in known]))
    field.w = np.zeros((len(field.names), len(LABELS)))
    seen_w, seen_t = np.full_like(field.w, 1e-6), np.full_like(field.t, 1e-6)
    for _ in range(passes):
        rng.shuffle(data)
        for segments, gold in data:
            _, rows, grad_t = field.log_likelihood(segments, gold)
            grad = np.zeros_like(field.w)
            for f, g in rows:
                grad[[field.names[x] for x in f]] += g
            grad -= ridge * field.w
            grad_t -= ridge * field.t
            seen_w += grad * grad
            seen_t += grad_t * grad_t
            field.w += rate * grad / np.sqrt(seen_w)
            field.t += rate * grad_t / np.sqrt(seen_t)
    return field


def _regions(text: str, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where the field looks: round each trigger outside the base spans, out to the ends of words; merged as they grow."""
    out: list[list[int]] = []
    k = 0
    for m in _TRIGGER.finditer(text):
        while k < len(covered) and covered[k][1] <= m.start():
            k += 1
        if k < len(covered) and covered[k][0] <= m.start():
            continue
        floor = out[-1][1] if out else 0
        a, b = max(0, m.start() - ROUND), min(len(text), m.end() + ROUND)
        if b <= floor:
            continue
        b = max(b, floor)
        while b < len(text) and text[b].isalnum():
            b += 1
        while a > floor and text[a - 1].isalnum():
            a -= 1
        if out and a <= floor:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def all_spans(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, spans that the field adds); the added ones overlap neither each other nor a base span."""
    base = base_spans(text)
    covered = sorted((a, b) for _, a, b in base)
    added: list[tuple[str, int, int]] = []
    c = 0
    for a, b in _regions(text, covered):
        tokens, places, barred = [], [], []
        for m in _TOKEN.finditer(text, a, b):
            while c < len(covered) and covered[c][1] <= m.start():
                c += 1
            tokens.append(m[0])
            places.append(m.span())
            barred.append(c < len(covered) and covered[c][0] < m.end())
        added += [(kind, places[i][0], places[j - 1][1]) for i, j, kind in field.best(_segments(tokens, barred))]
    return base, added


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (LABELS.index(s[0]), s[1])))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans, all that they cover goes."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = b
        else:
            at = max(at, b)
    return "".join(out) + text[at:]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of `docs`: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans), spans, n_spans.

    `spans` has the base spans and those that the field adds, of its further labels too; n_spans is how many they are.
    Places are code points, ends exclusive. A null text counts as empty: no spans. Whole texts are searched, each row
    by itself: a null doc_id stays null, rows that repeat one give a row each. An empty table gives no rows; columns
    of whatever other names are not read.
    """
    field = trained()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"]

    def run(batches):
        for b in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, spans, total = [], [], []
            for x in b.column(1):
                base, added = all_spans(x.as_py() or "", field)
                for c, kind in zip(counts, KINDS):
                    c.append(sum(k == kind for k, _, _ in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(base + added))
                total.append(len(base) + len(added))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(total, pa.int64())], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with every span of personal data in the text replaced by its kind in angle brackets; nulls stay null."""
    field = trained()
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            new = []
            for x in b.column(at):
                text = x.as_py()
                if text:
                    base, added = all_spans(text, field)
                    text = masked(text, base + added) if base or added else text
                new.append(text)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(new, b.column(at).type), *b.columns[at + 1 :]], names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)
