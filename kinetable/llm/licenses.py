"""Licence scans over a positional index of rare tokens, with DataFrame functions only.

The licence templates' words are weighed by inverse document frequency over all documents.  The ``POSTED`` rarest
words of each template's key phrase, and of the rest of it, are its postings (template, position).  Of each file the
words that are posted, which are its rarest licence words, are looked up; each posting says where its template would
start, and postings are intersected by that start: two at least must agree on it.  There the key phrase must stand word
for word and most of the other words, by weight, at their places.

A key phrase has two words at least, whose postings agree wherever it stands, so no place is lost.  A null text counts
as empty: no words, no labels, score 0.  Repeated rows give repeated results, an empty table none.  Whole texts are
read; every place is found, however long the text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.llm.licence_texts import PARAGRAPHS

#: Words of a text whose letters A to Z are in lower case, and the same before that.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A character that is in no word, and the ends of words in a text of either case.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Share of a template's weight that must stand in place.
IN_PLACE = 0.75
#: Words of a key phrase, and as many of the rest of a template, that are posted; postings that must agree; places of a score.
POSTED, AGREE, PLACES = 3, 2, 6


@dataclass(frozen=True)
class Template:
    """``key`` is the phrase within ``text`` that has to stand word for word."""

    label: str
    text: str
    key: str

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> int:
        w, k = self.words, self.key.split()
        return next(i for i in range(len(w)) if w[i : i + len(k)] == k)


#: Fixed phrases.
BASE = (
    Template("cc-by", "cc by", "cc by"),
    Template("gpl", "general public license", "general public license"),
    Template("reserved", "all rights reserved", "all rights reserved"),
)
MORE = tuple(Template(label, text, key) for label, key, text in PARAGRAPHS)
TEMPLATES = BASE + MORE


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def any_of(words: list[str]) -> str:
    """An expression for each of these words in a text of either case, as group 1; words that begin alike share a branch."""

    def branch(own: list[str]) -> str:
        heads = sorted({w[0] for w in own if w})
        parts = [h + branch([w[1:] for w in own if w and w[0] == h]) for h in heads]
        end = "" in own
        return "" if not parts else parts[0] if len(parts) == 1 and not end else f"(?:{'|'.join(parts)}){'?' if end else ''}"

    return f"(?i)(?:^|{GAP})({branch(words)})(?={GAP}|$)"


def weights(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """Inverse document frequency over all documents of the templates' words (as many rows reach the driver)."""
    vocabulary = sorted({w for t in templates for w in t.words})
    words = F.regexp_extract_all("text", F.lit(any_of(vocabulary)), F.lit(1))
    own = F.array_distinct(F.transform(words, lowered))
    held = docs.select(F.explode(F.concat(F.coalesce(own, F.array().cast("array<string>")), F.array(F.lit("")))).alias("word"))
    df = {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}
    return {w: math.log((df.get("", 0) + 1) / (df.get(w, 0) + 0.5)) for w in vocabulary}


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words and places array<struct<template int, start long, share double>> by start, then template."""
    idf = weights(docs, templates)
    rare: dict[Template, str] = {}
    postings: dict[str, list[tuple[int, int]]] = {}
    for i, t in enumerate(templates):
        key, rest = t.key.split(), t.words[: t.key_at] + t.words[t.key_at + len(t.key.split()) :]
        first = sorted(dict.fromkeys(key), key=lambda w: -idf[w])
        posted = {*first[:POSTED], *sorted(dict.fromkeys(rest), key=lambda w: -idf[w])[:POSTED]}
        if len(first) < AGREE:
            raise ValueError(f"the key phrase {t.key!r} has fewer than {AGREE} words")
        rare[t] = first[0]
        for p, w in enumerate(t.words):
            if w in posted:
                postings.setdefault(w, []).append((i, p))
    index = F.create_map(
        *[x for w, ps in postings.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(i).alias("t"), F.lit(p).alias("p")) for i, p in ps]))]
    )
    sheet = F.array(
        *[
            F.struct(
                F.array(*map(F.lit, t.words)).alias("words"),
                F.array(*[F.lit(max(idf[w], 1e-3)) for w in t.words]).alias("idf"),
                F.array(*map(F.lit, t.key.split())).alias("key"),
                F.lit(t.key_at).alias("at"),
            )
            for t in templates
        ]
    )
    most = 1 << 10  # votes are start * most + template
    assert len(templates) < most

    def vote_of(i: Column, w: Column) -> Column:
        starts = F.transform(F.element_at(index, F.get(w, i)), lambda p: (i - p["p"]).cast("long") * most + p["t"])
        return F.filter(starts, lambda v: v >= 0)

    def place(v: Column, w: Column) -> Column:
        start, n = F.floor(v / most), (v % most).cast("int")

        def judge(t: Column) -> Column:
            keyed = F.slice(w, (start + t["at"] + 1).cast("int"), F.size(t["key"])) == t["key"]
            placed = F.arrays_zip(t["words"].alias("a"), F.slice(w, (start + 1).cast("int"), F.size(t["words"])).alias("b"), t["idf"].alias("c"))
            there = F.aggregate(placed, F.lit(0.0), lambda s, x: s + F.when(x["a"] == x["b"], x["c"]).otherwise(0.0))
            every = F.aggregate(t["idf"], F.lit(0.0), lambda s, x: s + x)  # in the same order: the whole is 1
            return F.struct(n.alias("template"), start.alias("start"), F.when(keyed, F.least(there / every, F.lit(1.0))).otherwise(0.0).alias("share"))

        return F.transform(F.array(F.get(sheet, n)), judge)[0]

    def places(w: Column) -> Column:
        hits = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(sorted(postings)))
        votes = F.array_sort(F.flatten(F.transform(hits, lambda i: vote_of(i, w))))
        # In order, a start on which so many agree is the same so many places on.
        agreed = F.transform(F.array(votes), lambda s: F.array_distinct(F.filter(s, lambda v, i: v == F.get(s, i + AGREE - 1))))[0]
        return F.filter(F.transform(agreed, lambda v: place(v, w)), lambda x: x["share"] >= IN_PLACE)

    nothing = F.array().cast("array<struct<template:int,start:bigint,share:double>>")
    # Most texts hold the rarest word of no key phrase, which one expression over the raw text tells.
    some = F.col("text").rlike(any_of(sorted({*rare.values()})))
    words = F.regexp_extract_all(lowered(F.col("text")), F.lit(WORD), F.lit(0))
    found = F.transform(F.array(words), places)[0]
    return docs.select(
        "doc_id",
        F.coalesce(F.regexp_count("text", F.lit(WORD_ANY_CASE)), F.lit(0)).cast("long").alias("n_words"),
        F.coalesce(F.when(some, found), nothing).alias("places"),
    )


def summary(found: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: int = len(BASE)) -> DataFrame:
    names = F.array(*[F.lit(t.label) for t in templates])
    own = F.filter("places", lambda x: x["template"] < base)
    starts = F.transform(own, lambda x: x["start"])
    label = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda x: F.get(names, x["template"])))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(own).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        label(own).alias("base_labels"),
        label(F.col("places")).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("places", lambda x: x["share"])), F.lit(0.0)), PLACES).alias("score"),
    )


def sql(templates: tuple[Template, ...] = TEMPLATES, base: int = len(BASE)) -> str:
    """The same by all words of all texts against all words of all templates."""
    cells = [(i, p, w, t.key_at <= p < t.key_at + len(t.key.split())) for i, t in enumerate(templates) for p, w in enumerate(t.words)]
    cells_sql = ", ".join(f"({i}, {p}, '{w}', {str(k).lower()})" for i, p, w, k in cells)
    labels_sql = ", ".join(f"({i}, '{t.label}')" for i, t in enumerate(templates))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents
), w AS (
  SELECT r, unnest(ws) AS w, unnest(range(0, len(ws))) AS i FROM d
), t(t, p, w, k) AS (VALUES {cells_sql}
), l(t, label) AS (VALUES {labels_sql}
), f AS (
  SELECT t.w, greatest(ln(((SELECT count(*) FROM d) + 1) / (count(DISTINCT r) + 0.5::DOUBLE)), 0.001::DOUBLE) AS idf FROM (SELECT DISTINCT w FROM t) t LEFT JOIN w ON w.w = t.w GROUP BY 1
), a AS (
  SELECT t, sum(idf) AS every, count(*) FILTER (k) AS keys FROM t JOIN f USING (w) GROUP BY 1
), m AS (
  SELECT r, t, i - p AS s, sum(idf) AS there, count(*) FILTER (k) AS keyed FROM w JOIN t USING (w) JOIN f USING (w) WHERE i >= p GROUP BY ALL
), h AS (
  SELECT r, t, s, label, there / every AS share FROM m JOIN a USING (t) JOIN l USING (t) WHERE keyed = keys AND there / every >= {IN_PLACE}::DOUBLE
), g AS (
  SELECT r, count(*) FILTER (t < {base}) AS n_base, min(s) FILTER (t < {base}) AS first_word, max(s) FILTER (t < {base}) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (t < {base}) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM h GROUP BY 1
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  round(least(coalesce(score, 0), 1::DOUBLE), {PLACES}) AS score FROM d LEFT JOIN g USING (r)
"""
