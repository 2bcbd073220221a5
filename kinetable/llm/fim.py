"""Fill-in-the-middle training texts, cut by runs of character classes.

A text's units are its code points, and the class of a code point is how many bytes it takes in UTF-8.  Maximal runs of
one class are stored with their first byte and the units before them; a cut at a number of units finds its run by
binary search, and its byte by arithmetic: first byte + (cut - units before) x bytes of a unit.  So no text is decoded,
and a text of one class is one run.  All texts of a batch share one list of runs and one search.

Two cuts are drawn from the document's id; the text comes out as ``<P>`` prefix ``<S>`` suffix ``<M>`` middle (psm),
``<S>`` suffix ``<P>`` prefix ``<M>`` middle (spm), or as it is (plain).  Texts that are empty or hold a mark are plain, so that every
output gives its text back.  A null text counts as empty, a null doc_id draws like an empty one; rows that repeat are
drawn alike.  Map only: rows stay where they are, and a worker holds a batch's texts and PIECE bytes of a text's runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.llm.common import numbered, quoted

MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
#: Of 100 documents those that are cut, and of these those that put the suffix first.
CUT, SUFFIX_FIRST = 90, 20
#: Bytes whose classes are looked at together; bytes of texts that share one list of runs.
PIECE, TOGETHER = 1 << 20, 4 << 20


class Runs:
    """Maximal runs of code points of one width: first byte, units before, width."""

    def __init__(self, data: np.ndarray, borders: np.ndarray) -> None:
        """``data`` are the bytes of texts one after another, ``borders`` where each begins, and the end."""
        first, before, width, units, last = [], [], [], 0, 0
        starts, at = np.unique(borders), 0
        while at < len(data):
            end = min(at + PIECE, len(data))
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
            piece = data[at:end]
            lead = np.flatnonzero((piece & 0xC0) != 0x80)
            byte = piece[lead]
            wide = 1 + (byte >= 0xC0).astype(np.int8) + (byte >= 0xE0) + (byte >= 0xF0)
            new = np.empty(len(lead), bool)
            new[0], new[1:] = wide[0] != last, wide[1:] != wide[:-1]
            new[np.searchsorted(lead, starts[np.searchsorted(starts, at) : np.searchsorted(starts, end)] - at)] = True
            own = np.flatnonzero(new)
            first.append(lead[own] + at)
            before.append(own + units)
            width.append(wide[own])
            units, last, at = units + len(lead), wide[-1], end
        none = [np.empty(0, np.int64)]
        self.first, self.before, self.width = (np.concatenate(x or none).astype(np.int64) for x in (first, before, width))
        self.units, self.bytes = units, len(data)

    def byte_of(self, unit: np.ndarray) -> np.ndarray:
        """The byte before which so many units stand."""
        if not len(self.first):
            return np.zeros(len(unit), np.int64)
        run = np.searchsorted(self.before, unit, "right") - 1
        return self.first[run] + (unit - self.before[run]) * self.width[run]

    def unit_of(self, byte: np.ndarray) -> np.ndarray:
        """How many units stand before the byte, which has to begin one."""
        if not len(self.first):
            return np.zeros(len(byte), np.int64)
        run = np.maximum(np.searchsorted(self.first, byte, "right") - 1, 0)
        return self.before[run] + (byte - self.first[run]) // self.width[run]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings without nulls, and where each begins."""
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8))[at[0] : at[-1]], at - at[0]


def cut_texts(texts: pa.Array, low: np.ndarray, high: np.ndarray, form: list[str]) -> list[bytes]:
    """Each text in its form, cut after ``low`` and ``high`` units."""
    data, at = text_bytes(texts)
    runs = Runs(data, at)
    base = runs.unit_of(at[:-1])
    one, two = runs.byte_of(base + low), runs.byte_of(base + high)
    p, s, m = (MARKS[k].encode() for k in ("prefix", "suffix", "middle"))
    view, out = data.tobytes(), []
    for a, i, j, z, f in zip(at[:-1].tolist(), one.tolist(), two.tolist(), at[1:].tolist(), form, strict=True):
        if f == "plain":
            out.append(view[a:z])
        else:
            parts = (p, view[a:i], s, view[j:z], m, view[i:j]) if f == "psm" else (s, view[j:z], p, view[a:i], m, view[i:j])
            out.append(b"".join(parts))
    return out


def drawn(doc_id: Column, part: int) -> Column:
    """One of eight numbers under 2**32 that depend on the id alone."""
    own = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(own, 8 * part + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id), and n, form, prefix_chars, middle_chars (null if plain) and output for every row of (doc_id, text)."""
    keep = ["doc_id"] if keep is None else keep
    text, n = F.coalesce(F.col("text"), F.lit("")), F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    marked = F.lit(False)
    for mark in MARKS.values():
        marked = marked | text.contains(mark)
    plain = (n == 0) | marked | (drawn(F.col("doc_id"), 2) % 100 >= CUT)
    form = F.when(plain, "plain").when(drawn(F.col("doc_id"), 3) % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    a, b = (drawn(F.col("doc_id"), i) % (n + 1) for i in (0, 1))
    rows = numbered(docs.select(*map(quoted, keep), n, F.least(a, b), F.greatest(a, b), form, text))
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pa.compute.binary_length(batch.column(k + 4)).to_numpy(zero_copy_only=False)
            block = np.cumsum(size, dtype=np.int64) // TOGETHER
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(i, j - i)
                if not part.num_rows:
                    continue
                low, high = (part.column(k + c).to_numpy() for c in (1, 2))
                kind = part.column(k + 3).to_pylist()
                made = pa.array(cut_texts(part.column(k + 4), low, high, kind), pa.binary()).view(pa.string())
                none = np.array([f == "plain" for f in kind], bool)
                spans = (pa.array(x, pa.int64(), mask=none) for x in (low, high - low))
                old = [part.column(c) for c in range(k + 1)]
                yield pa.RecordBatch.from_arrays([*old, part.column(k + 3), *spans, made], names)

    new = [T.StructField("form", T.StringType()), T.StructField("prefix", T.LongType()), T.StructField("middle", T.LongType()), T.StructField("output", T.StringType())]
    out = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(rows.schema.fields[: k + 1])), *new])
    names = out.names
    return rows.mapInArrow(run, out).toDF(*keep, "n", "form", "prefix_chars", "middle_chars", "output")


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "|".join(MARKS.values()))
    one, two, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def summary(made: DataFrame) -> DataFrame:
    """What was made, with digests in place of texts."""
    whole = restored(F.col("form"), F.col("output"))
    digests = [F.sha2(c.cast("binary"), 256).alias(name) for name, c in (("output_sha256", F.col("output")), ("restored_sha256", whole))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS UBIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS UBIGINT) AS h4 FROM d
), c AS (
  SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS low, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS high,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, substr(t, 1, low) AS prefix, substr(t, low + 1, high - low) AS middle, substr(t, high + 1) AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
  sha256(CASE WHEN form = 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""
