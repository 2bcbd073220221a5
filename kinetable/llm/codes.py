"""Codes of vectors by product quantisation in whole numbers, with partial-distance search.

A component x becomes floor(256 x).  Vectors are cut into PARTS consecutive parts, each with a codebook of ENTRIES
entries that starts as the parts of the smallest vec_ids; two rounds assign every part to its nearest entry (squared
Euclidean distance, the lower index where two are as near) and move entries to the floors of their means.

The nearest entry is found by partial distances: dimensions are taken in the order of falling variance of the codebook;
for a block of parts at once, the distance to each entry grows dimension by dimension, and an entry is dropped as soon
as it strictly exceeds the best whole distance that its row has so far.  That begins with the entry that is nearest
in the first dimension, and falls as entries that lead are completed.  An entry as near as the best one is never dropped.

All arithmetic is exact: in 64 bits where it fits, in Python's integers where a batch or codebook holds larger numbers.
Sums are added up within tasks and shuffled as ENTRIES x length numbers for each; codebooks are all that is broadcast.

Vectors that are null or hold null or non-finite components, or magnitudes of 2**180 (which only doubles have), are
dropped.  Each length is a set of its own with codebooks of its own, and there may be LENGTHS of them; a length that
PARTS doesn't divide has longer parts first.  Of equal vec_ids the smaller vector comes first, null vec_ids last.  A
table of fewer than ENTRIES vectors has as many entries.  An error that no long can hold is null.  Repeated rows count
as rows; a table without a label has one label, null.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.llm.common import numbered, salted_join, small_join, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Lengths of vectors that a table may hold; rows of parts that are compared at once.
LENGTHS, TOGETHER = 256, 4096
_HIGHEST = 2.0**180

Books = dict[int, list[np.ndarray]]


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE x), in 64 bits if squared distances of such vectors fit, else as Python's integers."""
    v = np.floor(x * float(SCALE))
    fits = isqrt((1 << 61) // max(v.shape[1], 1))
    return v.astype(np.int64) if not v.size or np.abs(v).max() < fits else np.frompyfunc(int, 1, 1)(v)


def borders(length: int) -> list[int]:
    """Where the parts of a vector begin, and its end."""
    size, more = divmod(length, PARTS)
    return np.cumsum([0] + [size + (i < more) for i in range(PARTS)]).tolist()


class Search:
    """The nearest entry of one codebook, by partial distances."""

    def __init__(self, book: np.ndarray) -> None:
        self.book = book
        spread = book.astype(np.float64).var(0)
        self.order = np.argsort(-spread, kind="stable")
        #: Squares that were computed, for what pruning saves: see ``share``.
        self.squares = self.all = 0

    @property
    def share(self) -> float:
        """Of the squares that a search of all entries takes, the share that was computed."""
        return self.squares / max(self.all, 1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the index of the nearest entry and the squared distance."""
        book, n, (k, d) = self.book, len(x), self.book.shape
        if not d or not n:
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        order = self.order
        self.all += n * k * d
        part = (x[:, order[0], None] - book[None, :, order[0]]) ** 2
        self.squares += part.size
        lead = np.argmin(part, 1)
        best = self._complete(x, lead)
        row, entry = np.nonzero(part <= best[:, None])
        far = part[row, entry]
        for i, dim in enumerate(order[1:], 1):
            far = far + (x[row, dim] - book[entry, dim]) ** 2
            self.squares += len(far)
            if i == d - 1:
                break
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            least = np.minimum.reduceat(far, starts)
            at = np.flatnonzero(far == np.repeat(least, np.diff(np.r_[starts, len(row)])))
            at = at[np.r_[True, row[at][1:] != row[at][:-1]]]  # the entry that leads now, one for each row
            new = np.flatnonzero(entry[at] != lead)
            if len(new):
                lead = entry[at]
                best[new] = np.minimum(best[new], self._complete(x[new], lead[new]))
            stay = (far <= best[row]).astype(bool)
            row, entry, far = row[stay], entry[stay], far[stay]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(far, starts)
        at = np.flatnonzero(far == np.repeat(least, np.diff(np.r_[starts, len(row)])))
        at = at[np.r_[True, row[at][1:] != row[at][:-1]]]  # rows are in order and so are their entries: the lowest index
        return entry[at], far[at]

    def _complete(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        self.squares += x.size
        return ((x - self.book[entry]) ** 2).sum(1)


def finite_rows(vectors: DataFrame) -> DataFrame:
    """c0 (vec_id), c1 (label) and v (doubles) of the rows that are kept."""
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("string")
    rows = numbered(vectors.select("vec_id", label, F.col("embedding").cast("array<double>"))).withColumnRenamed("c2", "v")
    return rows.filter(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < _HIGHEST)))


def by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut to rows of one length, with a matrix of their last column."""
    for batch in batches:
        sizes = pa.compute.list_value_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False)
        for length in np.unique(sizes):
            own = batch if (sizes == length).all() else batch.filter(pa.array(sizes == length))
            for a in range(0, own.num_rows, TOGETHER):
                rows = own.slice(a, TOGETHER)
                yield rows, rows.column(rows.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, int(length))


def seeds(rows: DataFrame) -> Books:
    """The first codebooks: parts of the smallest vec_ids of each length."""
    order = Window.partitionBy("length").orderBy(F.col("c0").asc_nulls_last(), "v")
    first = rows.select(F.size("v").alias("length"), "c0", "v").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= ENTRIES)
    lengths: dict[int, list] = {}
    few = first.orderBy("length", "nth").select("length", "v").limit(LENGTHS * ENTRIES + 1).collect()
    for r in few:
        lengths.setdefault(r["length"], []).append(r["v"])
    if len(lengths) > LENGTHS or len(few) > LENGTHS * ENTRIES:
        raise ValueError(f"more than {LENGTHS} lengths of vectors")
    out = {}
    for length, vectors in lengths.items():
        x, at = whole(np.array(vectors, np.float64).reshape(len(vectors), length)), borders(length)
        out[length] = [x[:, a:z] for a, z in zip(at, at[1:], strict=False)]
    return out


def assigned(x: np.ndarray, length: int, searches: dict[int, list[Search]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each part: its number, its components, the entries and the distances."""
    v, at = whole(x), borders(length)
    for p, search in enumerate(searches[length]):
        own = v[:, at[p] : at[p + 1]]
        if search.book.dtype == object or v.dtype == object:
            own = own.astype(object)
        yield p, own, *search.nearest(own)


def moved(rows: DataFrame, books: Books) -> Books:
    """The codebooks after one round: each entry is the floor of the mean of its parts."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {n: [Search(b) for b in own] for n, own in books.items()}
        total = {n: [np.zeros(b.shape, object) for b in own] for n, own in books.items()}
        count = {n: [np.zeros(len(b), np.int64) for b in own] for n, own in books.items()}
        for _, x in by_length(batches):
            n = x.shape[1]
            for p, own, entry, _ in assigned(x, n, searches):
                count[n][p] += np.bincount(entry, minlength=len(count[n][p]))
                part = np.zeros(total[n][p].shape, own.dtype)
                np.add.at(part, entry, own)
                total[n][p] += part
        for n, parts in total.items():
            for p, part in enumerate(parts):
                met = np.flatnonzero(count[n][p])
                if not len(met) or not part.shape[1]:
                    continue
                e, d = (x.ravel() for x in np.meshgrid(met, np.arange(part.shape[1]), indexing="ij"))
                values = [int(v) for v in part[met].ravel()]
                columns = [np.full(len(e), n), np.full(len(e), p), e, d]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(c, pa.int32()) for c in columns),
                        pa.array([Decimal(v >> 32) for v in values], pa.decimal128(38, 0)),
                        pa.array([v & 0xFFFFFFFF for v in values], pa.int64()),
                        pa.array(count[n][p][e], pa.int64()),
                    ],
                    names=["length", "part", "entry", "dim", "high", "low", "n"],
                )

    schema = "length int, part int, entry int, dim int, high decimal(38,0), low long, n long"
    by = rows.select("v").mapInArrow(sums, schema).groupBy("length", "part", "entry", "dim")
    new = {n: [b.astype(object) for b in own] for n, own in books.items()}
    for r in by.agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n")).collect():  # as many as components of entries
        new[r["length"]][r["part"]][r["entry"], r["dim"]] = ((int(r["high"]) << 32) + r["low"]) // r["n"]
    return {n: narrowed(own, n) for n, own in new.items()}


def narrowed(own: list[np.ndarray], length: int) -> list[np.ndarray]:
    """Codebooks in 64 bits if distances fit."""
    fits = isqrt((1 << 61) // max(length, 1))
    return [b.astype(np.int64) for b in own] if all(abs(v) < fits for b in own for v in b.ravel()) else own


def codebooks(vectors: DataFrame, rounds: int = ROUNDS) -> Books:
    """For each length of vectors of (vec_id, embedding) a codebook for each part."""
    rows = finite_rows(vectors)
    books = seeds(rows)
    for _ in range(rounds if books else 0):
        books = moved(rows, books)
    return books


def digest(own: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in own for v in b.ravel()).encode()).hexdigest()


def encode(vectors: DataFrame, books: Books) -> DataFrame:
    """vec_id, label, length, code (one byte for each part) and error of every kept row of (vec_id, embedding, label)."""
    rows = finite_rows(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {n: [Search(b) for b in own] for n, own in books.items()}
        for batch, x in by_length(batches):
            code, error = np.empty((len(x), PARTS), np.uint8), np.zeros(len(x), object)
            for p, _, entry, far in assigned(x, x.shape[1], searches):
                code[:, p] = entry
                error = error + far
            errors = [int(e) if e < 1 << 63 else None for e in error]
            made = [pa.array(np.full(len(x), x.shape[1]), pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(errors, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=names)

    new = [T.StructField("length", T.IntegerType()), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())]
    out = T.StructType([*rows.schema.fields[:2], *new])
    names = out.names
    return rows.mapInArrow(run, out).withColumnsRenamed({"c0": "vec_id", "c1": "label"})


def decode(coded: DataFrame, books: Books, column: str = "decoded") -> DataFrame:
    """``coded`` with the vector that each code stands for."""
    lists = [F.array(*(F.array(*(F.lit(float(v) / SCALE) for v in e)).cast("array<double>") for e in b)) for own in books.values() for b in own]
    at = [n for n in books for _ in range(PARTS)]
    value = F.lit(None).cast("array<double>")
    for n in books:
        own = [book for m, book in zip(at, lists, strict=True) if m == n]
        parts = [F.get(book, entry_of(F.col("code"), p)) for p, book in enumerate(own)]
        value = F.when(F.col("length") == n, F.concat(*parts)).otherwise(value)
    return coded.withColumn(column, value)


def entry_of(code: Column, part: int) -> Column:
    return F.conv(F.hex(F.substring(code, part + 1, 1)), 16, 10).cast("int")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``: errors summed over equal labels, nulls together."""
    keyed = coded.withColumn("_key", F.coalesce(F.concat(F.lit("s"), F.col("label").cast("string")), F.lit("n")))
    sums = keyed.groupBy("_key").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"), F.count("*").alias("n"))
    sums = stored(sums, "labels")
    few = sums.select("_key", "label_error")
    many = sums.filter("n > 1000").isEmpty()
    return (small_join(keyed, few, "_key") if many or sums.count() <= 200_000 else salted_join(keyed, few, "_key", "inner", sums.select("_key", "n"))).drop("_key")


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code (hex), error, label_error and codebooks_sha256 of every kept row."""
    books = codebooks(vectors)
    coded = with_label_errors(stored(encode(vectors, books), "codes"))
    sha = F.lit(None).cast("string")
    for n, own in books.items():
        sha = F.when(F.col("length") == n, digest(own)).otherwise(sha)
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", sha.alias("codebooks_sha256"))


def sql(rounds: int = ROUNDS) -> str:
    """The whole search in SQL, for vectors of one length that PARTS divides."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT nth, p, any_value(s) AS s, min(struct_pack(far := far, k := k)) AS best FROM (
    SELECT x.nth, x.p, x.s, b.k, list_sum(list_transform(list_zip(x.s, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far FROM x JOIN b{i} AS b ON x.p = b.p)
  GROUP BY nth, p
)""")
        if i < rounds:
            steps.append(f"""b{i + 1} AS MATERIALIZED (
  SELECT b.p, b.k, coalesce(m.c, b.c) AS c FROM b{i} AS b LEFT JOIN (
    SELECT p, k, list(mean ORDER BY pos) AS c FROM (
      SELECT p, best.k AS k, pos, CAST(floor(sum(s[pos])::DOUBLE / count(*)) AS BIGINT) AS mean FROM a{i}, range(1, len(s) + 1) AS t(pos) GROUP BY ALL)
    GROUP BY p, k) AS m ON b.p = m.p AND b.k = m.k
)""")
    return f"""
WITH v AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS nth, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT nth, p, list_slice(e, p * len(e) // {PARTS} + 1, (p + 1) * len(e) // {PARTS}) AS s FROM v, range({PARTS}) AS t(p)
), b0 AS (
  SELECT p, nth - 1 AS k, s AS c FROM x WHERE nth <= {ENTRIES}
), {", ".join(steps)}, c AS (
  SELECT nth, string_agg(printf('%02x', best.k), '' ORDER BY p) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM a{rounds} GROUP BY nth
), h AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN c USING (nth), h
"""


SQL = sql()
