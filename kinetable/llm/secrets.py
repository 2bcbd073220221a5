"""Secret scans over a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over the trigrams that any match must hold.
Every block of documents gets an inverted index of those trigrams; postings are intersected and united as
the query says, and the rule's expression runs on the remaining documents only.  A rule without a mandatory
trigram runs on every document.

A null text counts as empty and has no spans; repeated rows give repeated results; an empty table gives none.
Spans are code points, end exclusive; spans of one kind never overlap, those of different kinds may.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.llm.common import map_texts, quoted

MOST_EXACT = 64


def any_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A match whose ``group`` is shorter than ``least`` is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


_KEYS = "|".join([*map(any_case, ("password", "passwd", "secret", "token")), any_case("api") + "_?" + any_case("key")])
#: The contract's rules, then the rules of this scanner.
BASE_RULES = (
    Rule("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login", r"[a-z][a-z0-9+]{1,9}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@[A-Za-z0-9.-]+"),
)
RULES = BASE_RULES + MORE_RULES


# A query is True (no condition), a trigram, or ("and" | "or", frozenset of queries).
def both(a, b):
    if a is True or b is True:
        return b if a is True else a
    own = frozenset().union(*[x[1] if isinstance(x, tuple) and x[0] == "and" else {x} for x in (a, b)])
    return next(iter(own)) if len(own) == 1 else ("and", own)


def either(a, b):
    if a is True or b is True:
        return True
    own = frozenset().union(*[x[1] if isinstance(x, tuple) and x[0] == "or" else {x} for x in (a, b)])
    return next(iter(own)) if len(own) == 1 else ("or", own)


def holds(word: str):
    """That a text holds this word, as a query over its trigrams."""
    found = True
    for i in range(len(word) - 2):
        found = both(found, word[i : i + 3])
    return found


def any_of(words: set[str]):
    found = None
    for w in sorted(words):
        found = holds(w) if found is None else either(found, holds(w))
    return True if found is None else found


def trigram_query(pattern: str):
    """What the trigrams of a lower-cased text must satisfy if the pattern matches in the text."""
    exact, query = _Reader(pattern).whole()
    return both(query, any_of(exact)) if exact is not None else query


# Of a part of an expression: the set of lower-cased words that it can match (None: too many), and a query for the rest.
Part = tuple[set[str] | None, object]
ANYTHING: Part = (None, True)
NOTHING: Part = ({""}, True)


def in_turn(parts: list[Part]) -> Part:
    """One part after another."""
    run: set[str] = {""}
    query, closed = True, True  # closed: run still is all that the parts match
    for exact, own in parts:
        query = both(query, own)
        if exact is not None and len(run) * len(exact) <= MOST_EXACT:
            run = {a + b for a in run for b in exact}
        else:
            query, closed = both(query, any_of(run)), False
            run = exact if exact is not None else {""}
    return (run, query) if closed else (None, both(query, any_of(run)))


def one_of(parts: list[Part]) -> Part:
    if all(e is not None and q is True for e, q in parts) and sum(len(e) for e, _ in parts) <= MOST_EXACT:
        return set().union(*[e for e, _ in parts]), True
    found = None
    for e, q in parts:
        own = both(q, any_of(e)) if e is not None else q
        found = own if found is None else either(found, own)
    return None, found


def repeated(part: Part, low: int, high: int | None) -> Part:
    exact, query = part
    if low == 0:
        return ({""} | exact, True) if high == 1 and exact is not None and query is True else ANYTHING
    if low == high == 1:
        return part
    return None, both(query, any_of(exact)) if exact is not None else query


class _Reader:
    """Reads an expression: letters, escapes, classes, groups, branches and repeats; the rest matches anything."""

    def __init__(self, pattern: str) -> None:
        self.p, self.i = pattern, 0

    def take(self, text: str) -> bool:
        if self.p.startswith(text, self.i):
            self.i += len(text)
            return True
        return False

    def whole(self) -> Part:
        found = self.branches()
        if self.i < len(self.p):
            raise ValueError(f"unbalanced parenthesis in {self.p!r}")
        return found

    def branches(self) -> Part:
        parts = [self.sequence()]
        while self.take("|"):
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else one_of(parts)

    def sequence(self) -> Part:
        parts: list[Part] = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            part = self.one()
            m = re.compile(r"([*+?]|\{(\d*)(,?)(\d*)\})[?+]?").match(self.p, self.i)
            if m and (m[1][0] != "{" or m[2] or m[4]):
                self.i = m.end()
                low = {"*": 0, "+": 1, "?": 0}.get(m[1], int(m[2] or 0))
                high = {"*": None, "+": None, "?": 1}[m[1]] if m[1] in "*+?" else int(m[4]) if m[4] else None if m[3] else low
                part = repeated(part, low, high)
            parts.append(part)
        return in_turn(parts)

    def one(self) -> Part:
        if self.take("("):
            if self.p.startswith("?", self.i):
                around = any(map(self.take, ("?=", "?!", "?<=", "?<!")))
                if not around and not self.take("?:") and not self.take("?>"):
                    m = re.compile(r"\?P<\w+>").match(self.p, self.i)
                    if not m:
                        raise ValueError(f"can't read {self.p!r} from {self.i}")
                    self.i = m.end()
            else:
                around = False
            found = self.branches()
            if not self.take(")"):
                raise ValueError(f"unbalanced parenthesis in {self.p!r}")
            return NOTHING if around else found
        if self.take("["):
            return self.characters()
        c = self.p[self.i]
        self.i += 1
        if c in "^$":
            return NOTHING
        if c == ".":
            return ANYTHING
        if c == "\\":
            c = self.escaped()
            return NOTHING if c in ("\\b", "\\B", "\\A", "\\Z") else ({c.lower()}, True) if len(c) == 1 else ANYTHING
        return {c.lower()}, True

    def escaped(self) -> str:
        """A character, or the escape of a kind of characters or places."""
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return chr(int(self.p[self.i - 2 : self.i], 16))
        if c in "nrtfv":
            return {"n": "\n", "r": "\r", "t": "\t", "f": "\f", "v": "\v"}[c]
        return "\\" + c if c.isalnum() else c

    def characters(self) -> Part:
        inverse, chars, wide, first = self.take("^"), set(), False, True
        while first or self.p[self.i] != "]":
            first = False
            c = self.p[self.i]
            self.i += 1
            if c == "\\":
                c = self.escaped()
            if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                z = self.p[self.i]
                self.i += 1
                if z == "\\":
                    z = self.escaped()
                if len(c) > 1 or len(z) > 1 or ord(z) - ord(c) >= 12:
                    wide = True
                else:
                    chars |= {chr(k).lower() for k in range(ord(c), ord(z) + 1)}
            elif len(c) > 1:
                wide = True
            else:
                chars.add(c.lower())
        self.i += 1
        return (chars, True) if not inverse and not wide and len(chars) <= 6 else ANYTHING


def trigrams_of(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*[trigrams_of(x) for x in query[1]])


class Scanner:
    """The rules, their queries, and the table of the trigrams that some query asks for."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = [(r, re.compile(r.pattern), trigram_query(r.pattern)) for r in rules]
        self.order = {r.kind: i for i, r in enumerate(rules)}
        self.asked = sorted(set().union(*[trigrams_of(q) for _, _, q in self.rules]))
        # A trigram over ASCII is 21 bits; those with another character can't be told apart by bytes and are never asked for here.
        self.number = np.zeros(1 << 21, np.int16)
        for i, t in enumerate(self.asked, 1):
            a, b, c = t.encode("ascii")
            self.number[a << 14 | b << 7 | c] = i
        self.fold = np.array([i + 32 if 65 <= i <= 90 else i if i < 128 else 0 for i in range(256)], np.uint32)

    def postings(self, texts: list[str]) -> dict[str, np.ndarray]:
        """For each trigram asked for, which of the texts hold it."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        ends = np.cumsum([len(r) + 2 for r in raw])
        codes = self.fold[np.frombuffer(b"\0\0".join([*raw, b""]), np.uint8)]
        key = codes[:-2] << 14
        key |= codes[1:-1] << 7
        key |= codes[2:]
        found = self.number[key]
        at = np.flatnonzero(found)
        hit = np.zeros((len(self.asked) + 1, len(texts)), bool)
        hit[found[at], np.searchsorted(ends, at, "right")] = True
        return {t: hit[i] for i, t in enumerate(self.asked, 1)}

    def candidates(self, query, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
        if query is True:
            return np.ones(n, bool)
        if isinstance(query, str):
            return postings[query]
        parts = [self.candidates(x, postings, n) for x in query[1]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)

    def scan(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """The spans of each text by start, then the order of the rules."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        if not texts:
            return out
        postings = self.postings(texts)
        for rule, pattern, query in self.rules:
            for i in np.flatnonzero(self.candidates(query, postings, len(texts))).tolist():
                for m in pattern.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[i].append((rule.kind, m.start(), m.end()))
        for spans in out:
            spans.sort(key=lambda s: (s[1], self.order[s[0]]))
        return out


#: Characters of text that share one inverted index.
BLOCK_CHARS = 500_000


def blocks(texts: list[str]) -> Iterator[slice]:
    start = chars = 0
    for i, t in enumerate(texts):
        if chars and chars + len(t) > BLOCK_CHARS:
            yield slice(start, i)
            start, chars = i, 0
        chars += len(t)
    yield slice(start, len(texts))


def scanner_for(rules: tuple[Rule, ...]):
    """A function that gives the spans of each of a list of texts; its scanner is made at its first call in a process."""
    made: list[Scanner] = []

    def spans(texts: list) -> list[list[tuple[str, int, int]]]:
        if not made:
            made.append(Scanner(rules))
        texts = [t or "" for t in texts]
        return [s for own in blocks(texts) for s in made[0].scan(texts[own])]

    return spans


def spans_of(texts: list, rules: tuple[Rule, ...] = RULES) -> list[list[tuple[str, int, int]]]:
    """The spans of each text."""
    return scanner_for(rules)(texts)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for every row of (doc_id, text)."""

    spans_in = scanner_for(rules)

    def found(texts: list) -> tuple[list]:
        return ([[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in spans_in(texts)],)

    return map_texts(docs, ["doc_id"], "spans array<struct<kind:string,start:bigint,end:bigint>>", found)


def masked(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with the mark of its kind in place of each span; of spans that overlap, in place of all together."""
    if not spans:
        return text
    out, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            out += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows and columns, with the secrets of ``text`` masked and ``n_chars``, if there is one, counted again."""

    spans_in = scanner_for(rules)

    def hidden(texts: list) -> tuple[list]:
        return ([masked(t, s) for t, s in zip(texts, spans_in(texts), strict=True)],)

    names = docs.columns
    rows = map_texts(docs, [c for c in names if c != "text"], "text string", hidden)
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*map(quoted, names))
