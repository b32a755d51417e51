"""Composition of id streams in context, and the way back.

A stream of token ids becomes base ids with a row of modifiers each. Function words, marks and spaces that stand before
a word wait until it is clear what carries them, and are given out as they were if nothing does; entries of the
metadata replace runs of ids where they end at word boundaries; title case that no entry knows is spelled in lower case
again. What a row says is always what the text has at that place: spaces, capitals and detached words that an entry
claims, but its context doesn't show, are cleared.

The metadata is as large as a vocabulary, not as a corpus, and is broadcast; streams are Arrow batches.
"""

from __future__ import annotations

import itertools
import math
import re
from array import array
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.plans.composition import merged_rows
from weft.sources.shared import slices

Row = tuple[int, ...]
#: Groups that hold literals of each kind, and the beginnings of the names of their values.
LITERALS = {
    "preposition": (("prepositions",), ("prep_",)),
    "pronoun": (("pronouns",), ("pron_",)),
    "determiner": (("determiners", "article_det", "articles"), ("det_", "article_")),
    "postposition": (("postpositions",), ("postp_",)),
    "prefix": (("prefix_punctuation",), ("punct_prefix_",)),
    "suffix": (("suffix_punctuation",), ("punct_suffix_",)),
    "possessive": (("possessives",), ("poss_",)),
}
#: Apostrophes that make a possessive only after an s and before a word.
BARE_APOSTROPHES = ("'", "\u2019")
#: Groups that go to the first token of several; the others go to the last.
FIRST_GROUPS = (
    "space_prefix", "base_capitalization", "determiners", "pronouns", "articles", "article_det", "article_space_prefix",
    "article_capitalization", "prepositions", "postpositions", "prep_space_prefix", "prep_capitalization", "prefix_punctuation",
)
#: Groups that speak of words standing apart from their base.
DETACHED_GROUPS = ("determiners", "article_det", "articles", "pronouns", "prepositions", "article_capitalization", "prep_capitalization", "article_space_prefix", "prep_space_prefix")
CAPITAL_OF = {"determiner": "article_capitalization", "preposition": "prep_capitalization"}
#: More tokens than this are no vocabulary, and aren't broadcast.
MOST_TOKENS = 1 << 20


@dataclass(frozen=True)
class Entry:
    """A run of ids, what it stands for, and how that is spelled if it is known."""

    token_ids: tuple[int, ...]
    base_ids: tuple[int, ...]
    rows: tuple[Row, ...]
    surface: str | None = None


@dataclass
class Metadata:
    """Groups of modifiers with the names of their values, the row that changes nothing, and the entries."""

    groups: tuple[str, ...]
    values: dict[str, list[str]]
    default: Row
    entries: list[Entry] = field(default_factory=list)

    @classmethod
    def read(cls, document: dict) -> Metadata:
        """From a composition document of version 1; other versions and rows of the wrong length are errors."""
        if int(document.get("version") or 1) != 1:
            raise ValueError("composition files of version 1 only")
        n = len(document["modifier_group_sizes"]) if document.get("modifier_group_sizes") else int(document["num_modifier_groups"])
        groups = tuple(document.get("group_names") or [f"group_{i}" for i in range(n)])
        default = tuple(document.get("default_modifier") or [0] * n)
        entries = []
        for e in [*(document.get("entries") or []), *(document.get("sequence_entries") or [])]:
            rows = e.get("modifier_rows")
            rows = [e["modifier"]] * len(e["base_ids"]) if rows is None else rows
            if len(rows) != len(e["base_ids"]) or any(len(r) != n for r in rows):
                raise ValueError("an entry needs a row of modifiers for each base, and a value for each group")
            entries.append(Entry(tuple(e["token_ids"]), tuple(e["base_ids"]), tuple(map(tuple, rows)), e.get("surface")))
        if len(groups) != n or len(default) != n:
            raise ValueError("group names and the default row need a value for each group")
        return cls(groups, {g: list(v) for g, v in (document.get("group_value_names") or {}).items()}, default, entries)

    @cached_property
    def at(self) -> dict[str, int]:
        return {g: i for i, g in enumerate(self.groups)}

    @cached_property
    def literals(self) -> dict[str, dict[str, tuple[int, int]]]:
        """Of each kind: literal to (place of its group, value); names are tried group by group."""
        out: dict[str, dict[str, tuple[int, int]]] = {}
        for kind, (groups, starts) in LITERALS.items():
            found = out.setdefault(kind, {})
            for g in groups:
                for v, name in enumerate(self.values.get(g, []) if g in self.at else []):
                    start = next((s for s in starts if name.startswith(s)), None)
                    if start is not None:
                        found[name[len(start) :]] = (self.at[g], v)
        return out

    @cached_property
    def spelled(self) -> dict[str, list[tuple[int, dict[int, str]]]]:
        """Of each kind: (place of a group, value to literal)."""
        out: dict[str, list[tuple[int, dict[int, str]]]] = {}
        for kind, (groups, _) in LITERALS.items():
            for g in (self.at[g] for g in groups if g in self.at):
                out.setdefault(kind, []).append((g, {v: word for word, (own, v) in self.literals[kind].items() if own == g}))
        return out

    def says(self, row: Row, group: str) -> bool:
        """Whether a group of yes and no says yes."""
        g = self.at.get(group)
        if g is None or row[g] == self.default[g]:
            return False
        names = self.values.get(group, [])
        name = names[row[g]].lower() if 0 <= row[g] < len(names) else ""
        if name.startswith(("with_", "add_")):
            return True
        return row[g] == 1 and not name.startswith(("remove_", "no_", "na_", "none"))

    def word(self, row: Row, kind: str) -> str | None:
        for g, words in self.spelled.get(kind, ()):
            if row[g] != self.default[g] and row[g] in words:
                return words[row[g]]
        return None

    def surface(self, base: str, row: Row) -> str:
        """A base under a row: words one space apart, marks right at them, a space before all if the row says so."""
        out = base.lstrip(" ") if base.strip() else base
        g = self.at.get("base_capitalization")
        if g is not None and row[g] != self.default[g]:
            names = self.values.get("base_capitalization", [])
            name = names[row[g]].lower() if 0 <= row[g] < len(names) else ""
            if row[g] == 1 or name.startswith(("add_", "with_")):
                out = _first_letter(out, str.upper)
            elif name.startswith(("remove_", "lower_")):
                out = _first_letter(out, str.lower)
        words = {kind: self.word(row, kind) or "" for kind in LITERALS}
        for kind, group in CAPITAL_OF.items():
            if self.says(row, group):
                words[kind] = _first_letter(words[kind], str.upper)
        out += words["possessive"]
        out = " ".join(filter(None, (words["preposition"], words["pronoun"], words["determiner"], out, words["postposition"])))
        out = words["prefix"] + out + words["suffix"]
        return f" {out}" if self.says(row, "space_prefix") and out and not out[0].isspace() else out


def _first_letter(text: str, change) -> str:
    for i, c in enumerate(text):
        if c.isalpha():
            return text[:i] + change(c) + text[i + 1 :]
    return text


def plain_case(text: str) -> bool:
    """No capitals, or only the first letter."""
    letters = [c for c in text if c.isalpha()]
    return not letters or all(c.islower() for c in letters) or (letters[0].isupper() and all(c.islower() for c in letters[1:]))


def begins_upper(text: str) -> bool:
    return next((c.isupper() for c in text if c.isalpha()), False)


class Token:
    """What is known of an id without its context."""

    __slots__ = ("bare", "blank", "bytes", "canon", "fragment", "odd", "space", "text", "upper", "word")

    def __init__(self, spelled: bytes):
        self.bytes = spelled
        try:
            self.text, self.fragment = spelled.decode(), False
        except UnicodeDecodeError:
            self.text, self.fragment = spelled.decode(errors="replace"), True
        self.bare = self.text.lstrip(" ")
        self.space = self.text.startswith(" ")
        self.blank = not self.text.strip()
        #: Spaces that no row can say.
        self.odd = not self.blank and (self.text.startswith("  ") or (self.space and self.bare[0].isspace()))
        self.word = any(c.isalnum() for c in self.bare)
        self.canon = "" if self.fragment else self.bare.lower()
        self.upper = self.bare[:1].isupper()


class Tries:
    """Runs of keys to what they end at; a node is a number, an edge a pair of node and key."""

    def __init__(self, runs: Iterable[tuple[Iterable, object]]):
        self.edges: dict[tuple, int] = {}
        self.ends: dict[int, object] = {}
        for keys, value in runs:
            node = 0
            for k in keys:
                node = self.edges.setdefault((node, k), len(self.edges) + 1)
            self.ends[node] = value  # a later run overwrites an equal one

    def walk(self, keys, at: int, stop: int):
        """(end, value) of every run that starts at `at`, the shortest first."""
        node = 0
        for i in range(at, stop):
            node = self.edges.get((node, keys(i)), -1)
            if node < 0:
                return
            if node in self.ends:
                yield i + 1, self.ends[node]


class Composer:
    """The two ways between ids and base ids with rows. `spelled`: bytes of each id; `words`: ids of a lower-case word."""

    def __init__(self, metadata: Metadata, spelled: Mapping[int, bytes], words: Mapping[str, list[int]]):
        self.meta, self.words = metadata, words
        self.tokens = {i: Token(b) for i, b in spelled.items()}
        self.forward = Tries((e.token_ids, e) for e in metadata.entries)
        self.backward = Tries((zip(e.base_ids, e.rows), e) for e in metadata.entries)
        self.space, self.cap = metadata.at.get("space_prefix"), metadata.at.get("base_capitalization")
        self.suffixes = metadata.at.get("suffix_punctuation")
        self.detached = [metadata.at[g] for g in DETACHED_GROUPS if g in metadata.at]
        self.marks = {x.lower() for kind in ("prefix", "suffix", "possessive") for x in metadata.literals[kind]}
        #: Postpositions by their words, and those of one word.
        self.after = Tries((x.split(" "), found) for x, found in metadata.literals["postposition"].items())
        self.single_after = {x for x in metadata.literals["postposition"] if " " not in x}
        self.function = {k: metadata.literals[k] for k in ("determiner", "preposition", "pronoun")}
        self._surfaces: dict[tuple[str, Row], str] = {}

    def surface(self, base: str, row: Row) -> str:
        if row == self.meta.default:
            return base
        found = self._surfaces.get((base, row))
        if found is None:
            found = self.meta.surface(base, row)
            if len(self._surfaces) < 200_000:
                self._surfaces[base, row] = found
        return found

    def text(self, ids: Iterable[int]) -> str:
        tokens = self.tokens
        return b"".join([tokens[i].bytes for i in ids]).decode(errors="replace")

    # --- ids to bases and rows

    def compose(self, ids: list[int]) -> tuple[list[int], list[Row]]:
        """Base ids and rows; ids as they are, with default rows, where those would not give back the same text."""
        made = self.composed(ids)
        if self.restore(*made) != self.text(ids):
            return list(ids), [self.meta.default] * len(ids)
        return made

    def composed(self, ids: list[int], start: int = 0, stop: int | None = None) -> tuple[list[int], list[Row]]:
        """Base ids and rows as the rules make them of the ids from `start` to `stop`, between the others; of all by default."""
        s = _Stream(self, ids)
        s.i, stop = start, len(ids) if stop is None else stop
        words, marks = (s.function_word, s.entry, s.title, s.literal), (s.possessive, s.suffix, s.opening, s.function_word, s.entry, s.title, s.literal)
        while s.i < stop:
            t = s.t[s.i]
            if t.odd:
                s.odd()
            elif t.blank:
                s.blank()
            elif t.fragment:
                s.component()
            else:
                for rule in marks if t.canon in self.marks or not t.word else words:
                    if rule():
                        break
                if self.after.edges:
                    s.postposition()
        s.flush()
        return s.ids, s.rows

    # --- and back

    def restore(self, ids: list[int], rows: list[Row]) -> str:
        """The text of base ids under rows: characters of several byte tokens, the longest known run, literals, single tokens.

        ids and rows of different number are an error.
        """
        if len(ids) != len(rows):
            raise ValueError(f"{len(ids)} ids and {len(rows)} rows of modifiers")
        tokens, default, out, i, n = self.tokens, self.meta.default, [], 0, len(ids)
        plain_from = None  # of a run of literals, whose bytes are decoded together
        for_pair = lambda k: (ids[k], rows[k])
        while i < n:
            end, made = i + 1, None
            if tokens[ids[i]].fragment:
                end = component_end([tokens[x].bytes for x in ids[i : i + 4]]) + i
                if end > i + 1 or not tokens[ids[i]].fragment:
                    made = self.surface(self.text(ids[i:end]), merged_rows(rows[i:end], default))
            if made is None:
                hit = None
                for hit in self.backward.walk(for_pair, i, n):
                    pass
                if hit:
                    end, made = hit[0], self._entry_surface(hit[1])
                elif rows[i] != default:
                    made = self.surface(tokens[ids[i]].text, rows[i])
            if made is None:
                plain_from = i if plain_from is None else plain_from
            else:
                if plain_from is not None:
                    out.append(self.text(ids[plain_from:i]))
                    plain_from = None
                out.append(made)
            i = end
        if plain_from is not None:
            out.append(self.text(ids[plain_from:]))
        return "".join(out)

    def _entry_surface(self, e: Entry) -> str:
        row = merged_rows(list(e.rows), self.meta.default)
        made = self.meta.surface(self.text(e.base_ids), row)
        if e.surface is None or e.surface == made or e.surface.casefold() == made.casefold():
            return made
        return self.meta.surface(e.surface, row)

    @cached_property
    def streams(self) -> Streams:
        """The same two ways for many streams at once."""
        return Streams(self)

    def length(self, i: int, row: Row) -> int:
        """Bytes of one token under a row; part of a character counts its own bytes, but for spaces that the row says."""
        t = self.tokens[i]
        if not t.fragment:
            return len(self.surface(t.text, row).encode())
        if row == self.meta.default:
            return len(t.bytes)
        return len(t.bytes.lstrip(b" ")) + len(self.meta.surface("x", row).encode()) - 1


def component_end(parts: list[bytes]) -> int:
    """How many of the first tokens, at most four, make whole characters together; 1 if none do."""
    pending = b""
    for k, part in enumerate(parts, 1):
        pending += part
        try:
            pending.decode()
        except UnicodeDecodeError:
            continue
        return k
    return 1


class _Stream:
    """One text's ids, what is given out, and what waits for a word: modifiers, the places they came from, a space."""

    def __init__(self, composer: Composer, ids: list[int]):
        self.c, self.raw, self.n, self.i = composer, ids, len(ids), 0
        self.t = [composer.tokens[x] for x in ids]
        self.ids: list[int] = []
        self.rows: list[Row] = []
        self.taken: list[tuple[int, int]] = []
        self.held: list[int] = []
        self.lead = False
        self.open = False  # whether a mark may join the last row
        self.ends: dict[int, int] = {}  # of tokens that make a character only together with the next
        self.word = [t.word for t in self.t]
        i = 0
        while i < self.n:
            end = i + 1
            if self.t[i].fragment:
                end = i + component_end([x.bytes for x in self.t[i : i + 4]])
                self.word[i] = end > i + 1 and any(ch.isalnum() for ch in composer.text(ids[i:end]))
                self.word[i + 1 : end] = [False] * (end - i - 1)
                self.ends[i] = end
            i = end
        #: Whether a token goes on with the word before it, if there is one.
        self.joins = [w and not t.space and not t.blank for w, t in zip(self.word, self.t)]
        self.joins.append(False)

    # What goes out

    def give(self, ids: Iterable[int], rows: Iterable[Row], open: bool = True) -> None:
        self.ids += ids
        self.rows += rows
        self.open = open
        self.taken, self.held, self.lead = [], [], False

    def row(self, *values: tuple[int | None, int], over: Row | None = None) -> Row:
        out = list(over or self.c.meta.default)
        for g, v in values:
            if g is not None:
                out[g] = v
        return tuple(out)

    def spaced(self, i: int) -> int:
        """Whether the word at `i` has a space before it, or what waits for it has: the waiting words come first."""
        if self.c.space is None:
            return 0
        if self.taken or self.lead:
            return int(self.lead) or self.c.meta.default[self.c.space]
        return 1 if self.t[i].space and not self.t[i].odd else self.c.meta.default[self.c.space]

    def put(self, i: int) -> None:
        """A token as it is."""
        t = self.t[i]
        row = self.c.meta.default if t.blank or t.odd else self.row((self.c.space, self.spaced(i)))
        self.give([self.raw[i]], [row], open=not t.odd)

    def flush(self) -> None:
        """What waits goes out as it came."""
        held, lead = self.held, self.lead
        self.taken, self.held = [], []
        for k, i in enumerate(held):
            # A space that a token has itself is its own again; one that was a token goes to the first that is held.
            self.lead = lead and k == 0
            self.put(i)
        self.lead = False

    def spread(self, row: Row, n: int) -> list[Row]:
        """A row over n tokens: some groups on the first, the others on the last."""
        default, names = self.c.meta.default, self.c.meta.groups
        if n == 1:
            return [row]
        first = tuple(v if g in FIRST_GROUPS else d for v, d, g in zip(row, default, names))
        last = tuple(d if g in FIRST_GROUPS else v for v, d, g in zip(row, default, names))
        return [first, *[default] * (n - 2), last]

    # What the context says

    def word_end(self, i: int) -> int:
        """One past the tokens that go on with the word at `i`."""
        j = i + 1
        while self.joins[j]:
            j += 1
        return j

    def hosts(self, i: int) -> bool:
        """Whether the token at `i` can say that a space stands before it."""
        if i >= self.n or self.c.space is None or self.t[i].space or self.t[i].text[:1].isspace():
            return False
        if self.word[i] or any(self.t[i].canon in words for words in self.c.function.values()):
            return True
        return self.t[i].canon in self.c.meta.literals["prefix"] and i + 1 < self.n and self.word[i + 1]

    def detaches(self, i: int, end: int, canon: str) -> bool:
        """Whether a function word can wait for the word after it: words apart by one space, in an order that rows know."""
        if not (i == 0 or self.t[i].space or self.t[i - 1].blank or self.taken):
            return False
        spaces = 0
        while end < self.n and self.t[end].blank:
            if self.t[end].text != " ":
                return False
            spaces += 1
            end += 1
        if end == self.n or not self.word[end] or spaces + len(self.t[end].text) - len(self.t[end].bare) != 1:
            return False
        following = self.c.text(self.raw[end : self.word_end(end)]).strip().lower()
        known = self.c.function
        if following in known["preposition"] or following in known["pronoun"]:
            return False
        return following not in known["determiner"] or canon in known["preposition"]

    # What is done with a place whatever stands there

    def odd(self) -> None:
        """Spaces that rows can't say, with what follows them."""
        self.flush()
        self.put(self.i)
        self.i += 1

    def blank(self) -> None:
        """A space waits, goes to the word after it or stays; other blanks stay."""
        t = self.t[self.i]
        if t.text == " " and self.taken:
            self.held.append(self.i)
        elif t.text == " " and self.hosts(self.i + 1):
            self.lead = True
        else:
            self.flush()
            self.put(self.i)
        self.i += 1

    def component(self) -> None:
        """Tokens that make a character together stay, and the first carries what waits."""
        end = self.ends.get(self.i, self.i + 1)
        if end == self.i + 1:  # bytes of no character
            self.flush()
            self.give([self.raw[self.i]], [self.c.meta.default], open=False)
            self.i += 1
            return
        first = self.row((self.c.space, self.spaced(self.i)), *self.taken)
        self.give(self.raw[self.i : end], [first, *[self.c.meta.default] * (end - self.i - 1)])
        self.i = end

    # Rules; each says whether it has dealt with the place

    def possessive(self) -> bool:
        """A possessive right after a word joins its row; a bare apostrophe is one after an s if another word follows behind a space."""
        i, t = self.i, self.t[self.i]
        known = self.c.meta.literals["possessive"].get(t.text)
        if known is None or not self.rows or not self.open or self.taken or i == 0 or not self.word[i - 1] or self.joins[i + 1]:
            return False
        row, default = self.rows[-1], self.c.meta.default
        closed = (known[0], self.c.suffixes, self.c.meta.at.get("postpositions"))
        if any(g is not None and row[g] != default[g] for g in closed):
            return False
        if t.text in BARE_APOSTROPHES:
            after = i + 1 if i + 1 == self.n or self.t[i + 1].text != " " else i + 2
            apart = after == i + 2 or (after < self.n and self.t[after].space)
            if self.t[i - 1].text[-1:].lower() != "s" or after >= self.n or not apart or not self.word[after]:
                return False
        self.rows[-1] = self.row(known, over=row)
        self.i += 1
        return True

    def suffix(self) -> bool:
        """A mark right after a word joins its row, if spelled as the metadata spells it; of marks in one token the first."""
        i, t, g = self.i, self.t[self.i], self.c.suffixes
        known = self.c.meta.literals["suffix"]
        if g is None or not self.rows or not self.open or self.taken or i == 0 or self.t[i - 1].blank or self.rows[-1][g] != self.c.meta.default[g]:
            return False
        rest: list[int] = []
        mark = t.text
        if mark not in known:
            if t.word or t.space:
                return False
            mark = max((x for x in known if t.text.startswith(x)), key=len, default="")
            rest = list(self.c.words[t.text[len(mark) :]]) if mark else []
            if not rest or self.c.text(rest) != t.text[len(mark) :]:
                return False
        self.rows[-1] = self.row(known[mark], over=self.rows[-1])
        if rest:
            self.give(rest, [self.c.meta.default] * len(rest))
        self.i += 1
        return True

    def postposition(self) -> None:
        """Words after a host, each behind one space, that are a postposition join the host's last row: the longest one.

        Function words and postpositions themselves are no hosts.
        """
        i, c = self.i, self.c
        if not 0 < i < self.n or self.taken or self.lead or not self.open or not self.word[i - 1] or self.joins[i]:
            return
        start = i - 1
        while start > 0 and self.joins[start] and self.word[start - 1]:
            start -= 1
        host = c.text(self.raw[start:i]).strip().lower()
        if host in c.single_after or any(host in words for words in c.function.values()):
            return
        spans: list[tuple[str, int]] = []

        def word(k: int) -> str | None:
            """The k-th word from here, as it is spelled; none where another space or mark comes first."""
            while len(spans) <= k:
                at = spans[-1][1] if spans else i
                if at < self.n and self.t[at].text == " " and at + 1 < self.n and not self.t[at + 1].space:
                    at += 1
                elif at >= self.n or not self.t[at].space or self.t[at].odd:
                    return None
                if not self.word[at] or self.t[at].fragment:
                    return None
                spans.append((c.text(self.raw[at : self.word_end(at)]).lstrip(" "), self.word_end(at)))
            return spans[k][0]

        hit = None
        for hit in c.after.walk(word, 0, self.n):
            pass
        if hit:
            count, (g, value) = hit
            if self.rows[-1][g] == c.meta.default[g] and (c.suffixes is None or self.rows[-1][c.suffixes] == c.meta.default[c.suffixes]):
                self.rows[-1] = self.row((g, value), over=self.rows[-1])
                self.i = spans[count - 1][1]

    def opening(self) -> bool:
        """A mark right before a word waits for it; it stands before all that waits, so nothing can wait already."""
        i, t = self.i, self.t[self.i]
        known = self.c.meta.literals["prefix"]
        if t.canon not in known:
            return False
        if self.taken:
            self.flush()
        if i + 1 == self.n or self.t[i + 1].blank or self.t[i + 1].space or not self.word[i + 1]:
            return False
        self.wait(i, i + 1, known[t.canon])
        return True

    def wait(self, i: int, end: int, *values: tuple[int, int]) -> None:
        self.lead = self.lead or (not self.taken and self.t[i].space)
        self.taken += values
        self.held += range(i, end)
        self.i = end

    def function_word(self) -> bool:
        """A determiner or preposition, in one token or in several, waits for the word after it."""
        i = self.i
        if not self.word[i]:
            return False
        if self.joins[i] and i > 0 and self.word[i - 1] and not self.taken:
            return False
        end = self.word_end(i)
        inside = i > 0 and self.word[i - 1] and not self.t[i].space
        surface = self.t[i].bare if end == i + 1 else self.c.text(self.raw[i:end]).lstrip(" ")
        canon = surface.lower()
        for kind, group in CAPITAL_OF.items():
            if canon not in self.c.function[kind]:
                continue
            capital = begins_upper(surface)
            if not inside and plain_case(surface) and (not capital or group in self.c.meta.at) and self.detaches(i, end, canon):
                self.wait(i, end, self.c.function[kind][canon], *([(self.c.meta.at[group], 1)] if capital else []))
                return True
        if self.taken and (canon in self.c.function["determiner"] or canon in self.c.function["preposition"]):
            self.flush()
        return False

    def match(self) -> tuple[int, Entry] | None:
        """The longest entry from here that neither starts nor ends inside a word, nor runs over words apart."""
        i, best = self.i, None
        if i > 0 and self.word[i] and not self.t[i].space and self.word[i - 1]:
            return None
        for end, e in self.c.forward.walk(self.raw.__getitem__, i, self.n):
            if end < self.n and self.word[end - 1] and self.word[end] and not self.t[end].space:
                continue
            if end > i + 1 and all(self.word[i:end]) and any(x.space for x in self.t[i + 1 : end]):
                continue
            best = end, e
        return best

    def entry(self) -> bool:
        """An entry's bases, with rows that say what this place shows: else it isn't used."""
        hit = self.match()
        if hit is None:
            return False
        c, i, (end, e) = self.c, self.i, hit
        default = c.meta.default
        raw = c.text(self.raw[i:end])
        rows = [list(r) for r in e.rows] if e.rows else []
        if not rows:
            return False
        attached = self.detaches(i, end, raw.strip().lower())
        for r in rows:
            for g in c.detached if not attached else ():
                r[g] = default[g]
        if c.cap is not None and not (begins_upper(raw) and plain_case(raw)):
            for r in rows:
                r[c.cap] = default[c.cap]
        if c.space is not None:
            for r in rows:
                r[c.space] = default[c.space]
        if not any(c.tokens[b].word for b in e.base_ids):  # marks only: they are literals rather than marks at nothing
            for g in (c.suffixes, c.meta.at.get("prefix_punctuation")):
                for r in rows if g is not None else ():
                    if c.text(e.base_ids).lstrip(" ") == raw.lstrip(" "):
                        r[g] = default[g]
        found = "".join(c.surface(c.tokens[b].bare if k == 0 else c.tokens[b].text, tuple(r)) for k, (b, r) in enumerate(zip(e.base_ids, rows)))
        if found != raw.lstrip(" ") or not found:
            return False
        if self.taken or self.lead:
            whole = merged_rows([tuple(r) for r in rows], default)
            if any(whole[g] != default[g] for g, _ in self.taken):
                return False
            rows = self.spread(self.row((c.space, self.spaced(i)), *self.taken, over=whole), len(rows))
        else:
            rows[0] = self.row((c.space, self.spaced(i)), over=tuple(rows[0]))
        self.give(e.base_ids, map(tuple, rows))
        self.i = end
        return True

    def title(self) -> bool:
        """A word in title case, in whatever tokens, as the ids of its lower case."""
        i, c = self.i, self.c
        if c.cap is None or not self.t[i].upper or not self.word[i]:
            return False
        end = self.word_end(i)
        surface = c.text(self.raw[i:end]).strip()
        if not surface.isalpha() or not surface[0].isupper() or not plain_case(surface):
            return False
        low = surface.lower()
        ids = list(c.words[low])
        if not ids or _first_letter(low, str.upper) != surface or c.text(ids) != low:
            return False
        row = self.row((c.cap, 1), (c.space, self.spaced(i)), *self.taken)
        self.give(ids, self.spread(row, len(ids)))
        self.i = end
        return True

    def literal(self) -> bool:
        """The token itself under what waits for it."""
        self.give([self.raw[self.i]], [self.row((self.c.space, self.spaced(self.i)), *self.taken)])
        self.i += 1
        return True


# --- many streams at once


#: What may be a word in title case, and parts of streams, and ids in them, that a worker remembers; what exceeds this is forgotten between two batches.
WORD = re.compile(r"[^\W\d_]+")
REMEMBERED, REMEMBERED_IDS = 120_000, 1_000_000


class Streams:
    """Streams end to end, cut into parts that the rules treat alike wherever they stand; a part that recurs is worked out once.

    Composition cuts before a word behind a space, where nothing waits: no rule looks back over that place, and none
    looks ahead over it but at what is excluded here (function words, apostrophes, marks behind a space, runs of
    entries), and before a word right behind a mark, for which `mark` stands in. It also cuts inside a plain word of
    several tokens, behind its first and before its last: of the rest of the word the rules only see that it goes on, for
    which `inner` stands in. Restoring cuts before every id with its row at which no run of an entry goes on.
    """

    def __init__(self, composer: Composer):
        self.c = c = composer
        meta = c.meta
        function = {w for words in c.function.values() for w in words}
        pieces = {w[a:b] for w in function for a in range(len(w)) for b in range(a + 1, len(w) + 1)}
        later = {k for e in meta.entries for k in e.token_ids[1:]}
        #: Whether composition can be cut at all; else a stream is one part.
        self.cuttable = (
            c.space is not None
            and meta.default[c.space] == 0
            and not c.after.edges
            and all(w.isascii() for w in function)
            and all(r[g] == meta.default[g] for e in meta.entries for r in e.rows for g in c.detached)
        )
        self.size = max(c.tokens, default=0) + 1

        def marked(condition) -> np.ndarray:
            out = np.zeros(self.size, bool)
            out[[i for i, t in c.tokens.items() if condition(i, t)]] = True
            return out

        self.begins = marked(lambda i, t: t.space and (t.word or t.fragment) and not (t.blank or t.odd) and t.canon not in c.marks and i not in later)
        self.ends = marked(lambda i, t: not t.blank and t.text not in BARE_APOSTROPHES)
        self.function = marked(lambda i, t: t.canon in function)
        by_canon: dict[str, list[int]] = {}
        for i, t in c.tokens.items():
            if t.canon in pieces:
                by_canon.setdefault(t.canon, []).append(i)
        #: Pairs of tokens that may spell a function word.
        self.spelling = np.array([a << 32 | b for w in function for k in range(1, len(w)) for a in by_canon.get(w[:k], ()) for b in by_canon.get(w[k:], ())], np.int64)
        self.blank = marked(lambda i, t: t.blank)
        self.marks = marked(lambda i, t: not (t.word or t.blank or t.fragment or t.canon in meta.literals["prefix"] or t.canon in meta.literals["possessive"] or t.text in BARE_APOSTROPHES))
        self.starts = marked(lambda i, t: t.word and not (t.space or t.blank or t.fragment) and t.canon not in c.marks and i not in later)
        self.mark = int(np.argmax(self.marks)) if self.marks.any() else -1
        self.opens = marked(lambda i, t: t.canon in meta.literals["prefix"])
        self.joins = marked(lambda i, t: t.word and not t.space and not t.blank)
        self.word = marked(lambda i, t: t.word)
        self.piece = marked(lambda i, t: t.canon in pieces)
        self.fragment = marked(lambda i, t: t.fragment)
        #: Tokens that a plain word doesn't have.
        self.special = marked(lambda i, t: t.fragment or t.upper or t.odd or t.canon in c.marks or i in later)
        plain = np.flatnonzero(self.joins & ~self.special & ~self.piece)
        self.inner = int(plain[0]) if len(plain) else -1
        #: Ids that a restored part can begin with: no byte of theirs goes on with a character before.
        self.first = marked(lambda i, t: bool(t.bytes) and not t.fragment and t.bytes[0] & 0xC0 != 0x80)
        #: Ids with rows that follow one another in an entry.
        self.following = list({two for e in meta.entries for two in itertools.pairwise(zip(e.base_ids, e.rows))})
        self.later_base = np.zeros(self.size, bool)
        self.later_base[[i for _, (i, _) in self.following]] = True
        self.bytes = {i: t.bytes for i, t in c.tokens.items()}
        self._forget()

    def _forget(self) -> None:
        self.kinds: dict[Row, int] = {self.c.meta.default: 0}
        two = [np.array([i << 32 | self._kind(r) for i, r in x], np.int64) for x in zip(*self.following)] or [np.zeros(0, np.int64)] * 2
        (one, a), (other, b) = (np.unique(x, return_inverse=True) for x in two)
        self.runs_on = (one, other), a.ravel() * len(other) + b.ravel()
        #: By whether a part begins inside a word (1) or behind a mark (2), and whether it ends inside a word (4): parts by their ids, and those of one id.
        self.parts: list[dict[bytes, int]] = [{} for _ in range(7)]
        self.single = np.full((7, self.size), -1, np.int64)
        self.ids, self.codes, self.offsets = array("i"), array("i"), array("q", [0])
        self.texts: dict[bytes, str] = {}
        self.held = 0

    def _fresh(self) -> None:
        if len(self.offsets) + len(self.texts) + len(self.kinds) > REMEMBERED or len(self.ids) + self.held > REMEMBERED_IDS:
            self._forget()

    def _kind(self, row: Row) -> int:
        return self.kinds.setdefault(row, len(self.kinds))

    # Ids to bases and rows

    def cuts(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where parts begin, and of every place how its part, if it begins (1, 2) or ends (4) there, goes on."""
        n = len(flat)
        cut, kind = np.zeros(n, bool), np.zeros(n, np.int64)
        cut[starts] = True
        if not self.cuttable or n < 2:
            return cut, kind
        before = np.concatenate([flat[:1], flat[:-1]])
        goes_on = self.joins[flat] & self.word[before] & ~cut
        heads = np.flatnonzero(~goes_on)
        sizes = np.diff(np.append(heads, n))
        # A word is a function word if its only token is one, if its two tokens spell one, or, perhaps, if all of several are pieces of one.
        function = np.where(sizes == 1, self.function[flat[heads]], np.logical_and.reduceat(self.piece[flat], heads))
        two = np.flatnonzero(function & (sizes == 2))
        function[two] = np.isin(flat[heads[two]].astype(np.int64) << 32 | flat[heads[two] + 1], self.spelling)
        # Whether bytes of a character are part of a word depends on what stands next to them.
        beside = self.fragment[flat] | self.fragment[before] | np.append(self.fragment[flat[1:]], False)
        unsure = np.logical_or.reduceat(beside, heads)
        plain = (sizes > 1) & ~unsure & ~np.logical_or.reduceat(self.special[flat], heads) & ~function & (self.inner >= 0)
        within = np.repeat(plain, sizes)
        kind[within] = 1
        kind[heads[plain]] = 4
        second = np.concatenate([before[:1], before[:-1]])
        maybe = self.function[before] | (self.joins[before] & self.word[second] & self.piece[before] & self.piece[second])
        waits = np.where(np.repeat(unsure, sizes), self.function[flat] | np.append(maybe[1:], True), np.repeat(function, sizes)) & ~self.fragment[flat]
        apart = np.concatenate([[False], ~waits[:-1]])
        cut |= self.begins[flat] & self.ends[before] & apart & ~(self.opens[before] & self.blank[second])
        cut |= kind == 1
        behind = self.starts[flat] & self.marks[before] & ~cut & (self.mark >= 0)
        kind[behind] |= 2
        return cut | behind, kind

    def _keep(self, ids: list[int], rows: list[Row]) -> int:
        """The number of a part that is composed."""
        self.ids.extend(ids)
        self.codes.extend([self._kind(r) for r in rows])
        self.offsets.append(len(self.ids))
        return len(self.offsets) - 2

    def _part(self, ids: list[int], inside: int) -> int:
        before = [[], [self.inner], [self.mark]][inside & 3]
        return self._keep(*self.c.composed([*before, *ids, *[self.inner] * (inside >> 2)], len(before), len(before) + len(ids)))

    def composed(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What Composer.compose makes of each of the streams of so many ids: base ids, values of their rows, how many of each stream."""
        self._fresh()
        c, groups = self.c, len(self.c.meta.groups)
        starts = np.cumsum(sizes) - sizes
        cut, kinds = self.cuts(flat, starts[sizes > 0])
        at = np.flatnonzero(cut)
        ends = np.append(at[1:], len(flat))[: len(at)]
        inside = kinds[at] & 3 | kinds[ends - 1] & 4
        parts = np.empty(len(at), np.int64)
        one = ends - at == 1
        ids, kind = flat[at[one]], inside[one]
        fresh = self.single[kind, ids] < 0
        for k, i in set(zip(kind[fresh].tolist(), ids[fresh].tolist())):
            self.single[k, i] = self._part([i], k)
        parts[one] = self.single[kind, ids]
        raw, numbers = flat.astype(np.int32).tobytes(), []
        several = list(zip((4 * at[~one]).tolist(), (4 * ends[~one]).tolist(), inside[~one].tolist()))
        if hasattr(c.words, "all"):  # words in title case are spelled in lower case: all at once
            new = {raw[a:b] for a, b, k in several if raw[a:b] not in self.parts[k]}
            c.words.all(list({w.lower() for x in new for w in WORD.findall(c.text(np.frombuffer(x, np.int32).tolist())) if w[0].isupper()}))
        for a, b, k in several:
            key = raw[a:b]
            n = self.parts[k].get(key)
            if n is None:
                n = self.parts[k][key] = self._part(flat[a // 4 : b // 4].tolist(), k)
            numbers.append(n)
        parts[~one] = numbers
        offsets = np.array(self.offsets, np.int64)
        n = (offsets[1:] - offsets[:-1])[parts]
        places = np.repeat(offsets[parts] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        made, codes = np.array(self.ids, np.int32)[places], np.array(self.codes, np.int64)[places]
        out = np.bincount(np.searchsorted(starts + sizes, at, "right"), n, len(sizes)).astype(np.int64)
        rows = list(self.kinds)
        # What would not give back its text stays as it is.
        spelled = list(map(self.bytes.__getitem__, flat.tolist()))
        back = self._restored(made, codes, rows, out)
        wrong = [k for k, (a, z) in enumerate(zip(starts.tolist(), (starts + sizes).tolist())) if b"".join(spelled[a:z]).decode(errors="replace") != back[k]]
        if wrong:
            bounds = np.concatenate([[0], np.cumsum(out)])
            as_is = set(wrong)
            streams = [(flat[starts[k] : starts[k] + sizes[k]], np.zeros(sizes[k], np.int64)) if k in as_is else (made[bounds[k] : bounds[k + 1]], codes[bounds[k] : bounds[k + 1]]) for k in range(len(sizes))]
            made, codes = np.concatenate([x for x, _ in streams]).astype(np.int32), np.concatenate([y for _, y in streams])
            out[wrong] = sizes[wrong]
        return made, np.array(rows, np.int32).reshape(-1, groups)[codes].ravel(), out

    # And back

    def coded(self, values: np.ndarray) -> tuple[np.ndarray, list[Row]]:
        """Of rows one after another, the place of each in a list of the different ones."""
        values = values.reshape(-1, len(self.c.meta.groups))
        if not len(values):
            return np.zeros(0, np.int64), []
        sizes = [int(x) + 1 for x in values.max(axis=0)]
        if values.min() >= 0 and math.prod(sizes) < 1 << 62:
            steps = np.array([math.prod(sizes[g + 1 :]) for g in range(len(sizes))], np.int64)
            _, where, at = np.unique(values.astype(np.int64) @ steps, return_index=True, return_inverse=True)
            kinds = values[where]
        else:
            kinds, at = np.unique(values, axis=0, return_inverse=True)
        return at.ravel(), [tuple(r) for r in kinds.tolist()]

    def restored(self, ids: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> list[str]:
        """What Composer.restore makes of each of the streams."""
        self._fresh()
        at, rows = self.coded(values)
        codes = np.array([self._kind(r) for r in rows], np.int64)[at] if len(at) else at
        return self._restored(ids, codes, list(self.kinds), sizes)

    def _restored(self, ids: np.ndarray, codes: np.ndarray, rows: list[Row], sizes: np.ndarray) -> list[str]:
        c, known = self.c, self.texts
        pairs = ids.astype(np.int64) << 32 | codes
        cut, doubtful = self.first[ids], np.flatnonzero(self.later_base[ids])
        doubtful = doubtful[doubtful > 0]
        if len(doubtful):
            (one, other), both = self.runs_on
            x, y = (np.minimum(np.searchsorted(u, v), len(u) - 1) for u, v in ((one, pairs[doubtful - 1]), (other, pairs[doubtful])))
            runs_on = (one[x] == pairs[doubtful - 1]) & (other[y] == pairs[doubtful]) & np.isin(x * len(other) + y, both)
            cut[doubtful[runs_on]] = False
        starts = np.cumsum(sizes) - sizes
        cut[starts[sizes > 0]] = True
        where = np.flatnonzero(cut)
        ends = np.append(where[1:], len(ids))[: len(where)]
        raw = pairs.tobytes()

        def text(a: int, b: int) -> str:
            key = raw[8 * a : 8 * b]
            out = known.get(key)
            if out is None:
                out = known[key] = c.restore(ids[a:b].tolist(), [rows[k] for k in codes[a:b].tolist()])
                self.held += b - a
            return out

        one = ends - where == 1
        _, example, at = np.unique(pairs[where[one]], return_index=True, return_inverse=True)
        texts = np.empty(len(where), object)
        texts[one] = np.array([text(a, a + 1) for a in where[one][example].tolist()], object)[at.ravel()]
        for k, a, b in zip(np.flatnonzero(~one).tolist(), where[~one].tolist(), ends[~one].tolist()):
            texts[k] = text(a, b)
        each, bounds = texts.tolist(), np.searchsorted(where, np.append(starts, len(ids))).tolist()
        return ["".join(each[a:b]) for a, b in zip(bounds, bounds[1:])]

    def lengths(self, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Composer.length of each id under its row."""
        at, rows = self.coded(values)
        pairs, where = np.unique(ids.astype(np.int64) << 32 | at, return_inverse=True)
        each = [self.c.length(p >> 32, rows[p & 0xFFFFFFFF]) for p in pairs.tolist()]
        return np.array(each, np.int32)[where.ravel()]


# --- streams as columns


_made: dict[int, Composer] = {}


class Shared:
    """Metadata, spelled ids and merge rules for all executors; bounded as a vocabulary is."""

    def __init__(self, spark, metadata: Metadata, spelled: dict[int, bytes], words: Mapping[str, list[int]]):
        if len(spelled) > MOST_TOKENS:
            raise ValueError(f"{len(spelled)} tokens are more than a vocabulary has")
        self.sent = spark.sparkContext.broadcast((metadata, spelled, words))

    def composer(self) -> Composer:
        """This worker's, made once."""
        key = self.sent.id if hasattr(self.sent, "id") else id(self.sent)
        if key not in _made:
            _made.clear()
            _made[key] = Composer(*self.sent.value)
        return _made[key]


def _listed(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _sizes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _flat(ids: pa.Array, rows: pa.Array, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, values of rows and sizes of streams; ids and rows of different number, and rows of another width, are errors."""
    sizes, flat = _sizes(ids), rows.flatten()
    if (sizes != _sizes(rows)).any() or (_sizes(flat) != groups).any():
        raise ValueError(f"every id needs a row of {groups} modifiers")
    return ids.flatten().to_numpy(zero_copy_only=False), flat.flatten().to_numpy(zero_copy_only=False), sizes


def composed_ids(df: DataFrame, key: str, ids: str, shared: Shared, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, base_ids, rows) of streams of ids; a null stream is an empty one."""
    schema = df.select(key, *keep, F.array(F.lit(0)).alias("base_ids"), F.array(F.array(F.lit(0))).alias("rows")).schema

    def run(batches):
        c = shared.composer()
        for b in slices(batches, -1):
            x, groups = b.column(b.num_columns - 1), len(c.meta.groups)
            made, values, sizes = c.streams.composed(x.flatten().to_numpy(zero_copy_only=False), _sizes(x))
            rows = _listed(pa.array(values, pa.int32()), np.full(len(made), groups))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], _listed(pa.array(made, pa.int32()), sizes), _listed(rows, sizes)], names=[key, *keep, "base_ids", "rows"])

    return df.select(key, *keep, ids).mapInArrow(run, schema)


def restored_text(df: DataFrame, key: str, base_ids: str, rows: str, shared: Shared, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, text) of base ids with rows."""
    schema = df.select(key, *keep).withColumn("text", F.lit("")).schema

    def run(batches):
        c = shared.composer()
        for b in slices(batches, -1):
            texts = c.streams.restored(*_flat(b.column(b.num_columns - 2), b.column(b.num_columns - 1), len(c.meta.groups)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(texts, pa.string())], names=[key, *keep, "text"])

    return df.select(key, *keep, base_ids, rows).mapInArrow(run, schema)


def byte_lengths(df: DataFrame, key: str, base_ids: str, rows: str, shared: Shared, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, lengths): the bytes that each base id stands for under its row; parts of a character count their own."""
    schema = df.select(key, *keep, F.array(F.lit(0)).alias("lengths")).schema

    def run(batches):
        c = shared.composer()
        for b in slices(batches, -1):
            ids, values, sizes = _flat(b.column(b.num_columns - 2), b.column(b.num_columns - 1), len(c.meta.groups))
            lengths = _listed(pa.array(c.streams.lengths(ids, values), pa.int32()), sizes)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], lengths], names=[key, *keep, "lengths"])

    return df.select(key, *keep, base_ids, rows).mapInArrow(run, schema)


def framed(base_ids: Column, rows: Column, default: Row, before: int | None = None, after: int | None = None) -> tuple[Column, Column]:
    """(ids, rows) with an id before and behind, under the default row."""
    one = lambda i: ([F.array(F.lit(i).cast("int"))], [F.array(F.array(*map(F.lit, default)))]) if i is not None else ([], [])
    (a, x), (b, y) = one(before), one(after)
    return F.concat(*a, base_ids, *b), F.concat(*x, rows, *y)
