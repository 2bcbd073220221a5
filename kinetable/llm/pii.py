"""Personal data in plain and in disguised form, with offsets into the source text.

Detectors find e-mail addresses, IP addresses, card and phone numbers.  They first run on the text itself and then on
its normal form, which transducers make: one replaces character references, one look-alike characters (and drops
invisible ones), one undoes disguises of "@" and "." and of spelled addresses, one turns spelled digits into digits.
They run in turn until none changes anything, as what one writes another may read.  Each transducer rewrites some places
of a tape and keeps, for every character of the new text, the source characters that it stands for; so a span of the
normal form maps back to the source.  Spans that hold a rewritten place are added, as kinds of their own.

Spans have a score: 1 in plain text, ``HIDDEN_SCORE`` in disguise, ``BARE_SCORE`` for spelled numbers of a phone number's
length that nothing marks as one.  A null text counts as empty; repeated rows give repeated results; an empty table gives
none.  Spans are code points, end exclusive; those of one kind don't overlap, those of different kinds may.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from kinetable.llm.common import map_texts

Span = tuple[int, int]
KINDS = ("email", "ip", "card", "phone")
HIDDEN = tuple(f"hidden_{k}" for k in KINDS)
HIDDEN_SCORE, BARE_SCORE = 0.9, 0.5
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A match is greedy, so none starts within a run of digits.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[Span]:
    """From each "@" to the left as far as the local part goes, not over the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text) if _DIGITS.search(text) else ():
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    own = [int(c) for c in reversed(digits)]
    return sum(own[0::2] + [x * 2 - 9 * (x > 4) for x in own[1::2]]) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = "".join(_DIGITS.findall(m[0]))
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGITS.findall(m[0])) <= 15:
                yield m.span()


DETECTORS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))

# Characters that look like those below them, in order.
_ALIKE = "АВЕЅІЈКМНОРСТХУаеорсхуѕіјԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοιανρ"
_LATIN = "ABESIJKMHOPCTXYaeopcxysijdhqwABEZHIKMNOPTYXoiavp"
#: Invisible characters, dashes, spaces and full stops of other kinds.
_INVISIBLE = "­​‌‍⁠﻿"
_DASHES, _SPACES, _STOPS = "‐‑‒–—−", "    ", "。․｡"


#: Blocks of compatibility characters: those whose normal form is ASCII stand for it.
_COMPATIBLE = ((0xA0, 0x250), (0x1D00, 0x2500), (0x3200, 0x3400), (0xFB00, 0xFFF0), (0x1D400, 0x1D800), (0x1F100, 0x1F200))


def _alike() -> dict[str, str]:
    out = dict(zip(_ALIKE, _LATIN, strict=True))
    for c in (chr(i) for a, z in _COMPATIBLE for i in range(a, z)):
        to = unicodedata.normalize("NFKC", c)
        if to != c and to.isascii() and to.isprintable() and c not in out:
            out[c] = to
    out |= {c: str(unicodedata.decimal(c)) for c in map(chr, range(0x600, 0x1E960)) if unicodedata.decimal(c, None) is not None and c not in out}
    for chars, to in ((_INVISIBLE, ""), (_DASHES, "-"), (_SPACES, " "), (_STOPS, ".")):
        out |= dict.fromkeys(chars, to)
    return out


ALIKE = _alike()
_ALIKE_RE = re.compile("[" + "".join(map(re.escape, ALIKE)) + "]")
#: Fixed words for "@", "." and "+", and for the digits from 0, of English, German, French and Spanish.
AT_WORDS, DOT_WORDS, PLUS_WORDS = ("at", "arroba", "arobase", "ät"), ("dot", "punkt", "point", "punto"), ("plus", "más", "mas")
DIGIT_WORDS = (
    ("zero", "oh", "null", "zéro", "cero"),
    ("one", "eins", "un", "uno"),
    ("two", "zwei", "zwo", "deux", "dos"),
    ("three", "drei", "trois", "tres"),
    ("four", "vier", "quatre", "cuatro"),
    ("five", "fünf", "cinq", "cinco"),
    ("six", "sechs", "seis"),
    ("seven", "sieben", "sept", "siete"),
    ("eight", "acht", "huit", "ocho"),
    ("nine", "neun", "neuf", "nueve"),
)
#: Words that double or triple the next digit.
REPEATS = {"double": 2, "triple": 3, "doppel": 2, "doppelt": 2, "doble": 2, "treble": 3}
_VALUE = {w: str(i) for i, words in enumerate(DIGIT_WORDS) for w in words}
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_AT, _DOT, _NUMBER = "|".join(AT_WORDS), "|".join(DOT_WORDS), "|".join(sorted(_VALUE, key=len, reverse=True))
#: A bracketed sign or word, with the blanks around it; signs between blanks; words between blanks.
_AT_MARK = re.compile(rf"[\x20\t]?{_OPEN}[\x20\t]?(?:{_AT}|@)[\x20\t]?{_CLOSE}[\x20\t]?", re.I)
_DOT_MARK = re.compile(rf"[\x20\t]?{_OPEN}[\x20\t]?(?:{_DOT}|\.)[\x20\t]?{_CLOSE}[\x20\t]?", re.I)
_SPACED = re.compile(r"[\x20\t]+@[\x20\t]+")
_SPOKEN = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?:[\x20\t]+(?:{_DOT})[\x20\t]+[A-Za-z0-9_%+-]{{1,64}}){{0,4}}(?:[\x20\t]+(?:{_AT})[\x20\t]+|@)[A-Za-z0-9-]{{1,63}}(?:(?:[\x20\t]+(?:{_DOT})[\x20\t]+|\.)[A-Za-z0-9-]{{1,63}}){{1,6}}", re.I
)
_SPOKEN_AT, _SPOKEN_DOT = re.compile(rf"[\x20\t]+(?:{_AT})[\x20\t]+", re.I), re.compile(rf"[\x20\t]+(?:{_DOT})[\x20\t]+", re.I)
_UNIT = rf"(?:(?:{'|'.join(REPEATS)})[\x20\t-])?(?:{_NUMBER})(?![^\W_])"
_OCTET = rf"(?:[0-9]{{1,3}}|{_UNIT}(?:[\x20\t-]{_UNIT}){{0,2}})"
_SPOKEN_IP = re.compile(rf"(?<![^\W_.]){_OCTET}(?:(?:[\x20\t]+(?:{_DOT})[\x20\t]+|\.){_OCTET}){{3}}(?![^\W_]|\.[^\W_])", re.I)
_IN_IP = re.compile(rf"[\x20\t]+(?:{_DOT})[\x20\t]+|{_UNIT}(?:[\x20\t-]{_UNIT})*", re.I)
_SPELLED = re.compile(rf"(?<![^\W_])(?:(?:{'|'.join(PLUS_WORDS)})[\x20\t-]+|\+[\x20\t]?)?(?:{_UNIT}|[0-9]+)(?:[\x20\t,.-]{{1,2}}(?:{_UNIT}|[0-9]+(?![^\W_]))){{1,}}", re.I)
_ENTITY = re.compile(r"&(?:#[0-9]{2,7}|#[xX][0-9a-fA-F]{2,6}|[A-Za-z]{2,24});")
_PIECE = re.compile(r"[^\W_]+|\+")
LEAST_SPELLED = 3
_ALIKE_SET, _AT_HINT, _DOT_HINT = frozenset(ALIKE), frozenset(AT_WORDS), frozenset(DOT_WORDS)
_RUN = re.compile(r"[^\W_]+")
#: Three digit words in a run of digit words (1) and digits (2).
_DIGIT_RUN = re.compile(rb"\x01\x02*\x01\x02*\x01")
#: Spoken "at" before a domain with literal dots: a word like any other unless the domain ends in one of these.
ENDINGS = "com org net edu gov mil int info biz io dev app ai co uk ie de at ch fr es it nl be pt pl se no dk fi cz gr eu us ca mx br ar cl au nz jp cn kr in ru tr za example test".split()
_AT_DOMAIN = re.compile(rf"[\x20\t](?:{'|'.join(x for w in AT_WORDS for x in (w, w.upper(), w.capitalize()))})[\x20\t]+(?:[A-Za-z0-9-]{{1,63}}\.)+(?:{'|'.join(x for w in ENDINGS for x in (w, w.upper()))})(?!\.?[A-Za-z0-9-])")


def _spells(low: str) -> bool:
    """Whether three digit words stand in a run of such and of digits, whatever separates them; any spelled number has that.

    One that is doubled or tripled counts as two or three.
    """
    words = _RUN.findall(low)
    if not any(map(_VALUE.__contains__, words)):
        return False
    marks, times = bytearray(), 1
    for w in words:
        if w in REPEATS:
            times = REPEATS[w]
            continue
        marks += b"\x01" * times if w in _VALUE else b"\x02" if w.isdigit() else b"\0"
        times = 1
    return _DIGIT_RUN.search(marks) is not None


def digits_of(pieces: list[str]) -> str:
    """The digits that words stand for."""
    out, times = [], 1
    for w in pieces:
        if w in REPEATS:
            times = REPEATS[w]
            continue
        out.append("+" if w == "+" or w in PLUS_WORDS else _VALUE.get(w, w) * times)
        times = 1
    return "".join(out)


@dataclass
class Tape:
    """A text, and for each of its characters the source's from ``start`` up to ``end`` and whether it is rewritten."""

    text: str
    start: np.ndarray
    end: np.ndarray
    new: np.ndarray

    @classmethod
    def of(cls, text: str) -> Tape:
        at = np.arange(len(text))
        return cls(text, at, at + 1, np.zeros(len(text), bool))

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Each (from, to, characters), in order and apart, put in place; an empty one marks its neighbour."""
        if not edits:
            return self
        text, parts, done = [], [], 0
        for a, z, to in edits:
            text += [self.text[done:a], to]
            parts.append((self.start[done:a], self.end[done:a], self.new[done:a]))
            n = len(to)
            parts.append((np.full(n, self.start[a]), np.full(n, self.end[z - 1]), np.ones(n, bool)))
            done = z
        text.append(self.text[done:])
        parts.append((self.start[done:], self.end[done:], self.new[done:]))
        start, end, new = (np.concatenate(x) for x in zip(*parts, strict=True))
        # What has been dropped stands between two characters that don't touch.
        if len(start) > 1:
            new[:-1] |= start[1:] > end[:-1]
        return Tape("".join(text), start, end, new)


def references(tape: Tape) -> Tape:
    """Character references of web pages; unknown ones stay."""
    if "&" not in tape.text:
        return tape
    edits = [(m.start(), m.end(), html.unescape(m[0])) for m in _ENTITY.finditer(tape.text)]
    return tape.rewritten([(a, z, to) for a, z, to in edits if to != tape.text[a:z]])


def look_alikes(tape: Tape) -> Tape:
    if tape.text.isascii():
        return tape
    return tape.rewritten([(m.start(), m.end(), ALIKE[m[0]]) for m in _ALIKE_RE.finditer(tape.text)])


def at_and_dot(tape: Tape) -> Tape:
    text, low = tape.text, tape.text.lower()
    if any(c in text for c in "[({<"):
        marks = [(m.start(), m.end(), "@") for m in _AT_MARK.finditer(text)] + [(m.start(), m.end(), ".") for m in _DOT_MARK.finditer(text)]
        tape = tape.rewritten(apart(marks))
        text, low = tape.text, tape.text.lower()
    if " @" in text or "\t@" in text:
        tape = tape.rewritten([(m.start(), m.end(), "@") for m in _SPACED.finditer(text)])
        text, low = tape.text, tape.text.lower()
    if any(w in low for w in DOT_WORDS) or _AT_DOMAIN.search(text):
        edits = []
        for m in _SPOKEN.finditer(text):
            dots = [(x.start(), x.end(), ".") for x in _SPOKEN_DOT.finditer(text, *m.span())]
            ats = [(x.start(), x.end(), "@") for x in _SPOKEN_AT.finditer(text, *m.span())]
            if dots or _AT_DOMAIN.search(text, m.start(), m.end() + 2):  # "at" alone is a word like any other
                edits += dots + ats
        for m in _SPOKEN_IP.finditer(text):
            if _SPOKEN_DOT.search(text, *m.span()):
                edits += [(x.start(), x.end(), "." if _SPOKEN_DOT.fullmatch(x[0]) else digits_of(_PIECE.findall(x[0].lower()))) for x in _IN_IP.finditer(text, *m.span())]
        tape = tape.rewritten(apart(edits))
    return tape


def spelled_digits(tape: Tape) -> Tape:
    if not _spells(tape.text.lower()):
        return tape
    edits = []
    for m in _SPELLED.finditer(tape.text):
        words = _PIECE.findall(m[0].lower())
        if sum(w in _VALUE for w in words) + sum(REPEATS.get(w, 1) - 1 for w in words) >= LEAST_SPELLED:
            number = digits_of(words)
            edits.append((m.start(), m.end(), number if number[0] == "+" or not 8 <= len(number) <= 15 else "+" + number))
    return tape.rewritten(edits)


def apart(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """In order, without those that overlap an earlier one."""
    out: list[tuple[int, int, str]] = []
    for e in sorted(edits):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


TRANSDUCERS = (references, look_alikes, at_and_dot, spelled_digits)


def normal_form(text: str) -> Tape | None:
    """The tape on which no transducer changes anything, None if none has rewritten anything."""
    # A text that can't change has no tape made for it.
    low = text.lower()
    words = low.split()
    if not (
        (not text.isascii() and not _ALIKE_SET.isdisjoint(text))
        or not _DOT_HINT.isdisjoint(words)
        or " @" in text
        or "\t@" in text
        or ("&" in text and _ENTITY.search(text))
        or (any(c in text for c in "[({<") and (_AT_MARK.search(text) or _DOT_MARK.search(text)))
        or (not _AT_HINT.isdisjoint(words) and _AT_DOMAIN.search(text))
        or _spells(low)
    ):
        return None
    tape, last = Tape.of(text), None
    while last is not tape:  # every change makes the text shorter or leaves fewer odd characters in it
        last = tape
        for step in TRANSDUCERS:
            tape = step(tape)
    return tape if tape.new.any() else None


def scored_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans with their scores, by kind as listed, then start."""
    text = text or ""
    out = [(kind, a, z, 1.0) for kind, find in DETECTORS.items() for a, z in find(text)]
    tape = normal_form(text)
    if tape is not None:
        rewritten = np.concatenate([[0], np.cumsum(tape.new)])
        for kind, find in DETECTORS.items():
            for a, z in find(tape.text):
                if rewritten[z] > rewritten[a]:
                    start, end = int(tape.start[a]), int(tape.end[z - 1])
                    bare = kind == "phone" and not _PLUS.match(text, start)
                    out.append((f"hidden_{kind}", start, end, BARE_SCORE if bare else HIDDEN_SCORE))
    return out


#: What marks a phone number: a plus sign of any form, or a word for it.
_PLUS = re.compile(rf"[+＋﹢⁺₊]|&|(?:{'|'.join(PLUS_WORDS)})\b", re.I)


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    return [s[:3] for s in scored_spans(text)]


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, score>>) for every row of (doc_id, text)."""

    def found(texts: list) -> tuple[list]:
        return ([[{"kind": k, "start": a, "end": z, "score": s} for k, a, z, s in scored_spans(t)] for t in texts],)

    return map_texts(docs, ["doc_id"], "spans array<struct<kind:string,start:bigint,end:bigint,score:double>>", found)
