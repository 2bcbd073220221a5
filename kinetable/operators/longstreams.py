"""Scans over streams that are longer than a task should take.

A window over a stream's key is one task for each stream.  Here a stream with more than so many rows is cut into ranges
of its order, by approximate quantiles of it, and each range is a partition of its own: windows run within ranges, each
range also gives a summary (its sum, its last value, its largest), the summaries of a stream are scanned in turn, and a
range's rows are finished with what the ranges before it, or after it, hand on.  All of these summaries are associative,
so the result is that of one window over the whole stream.

Rows that are equal in the first column of the order are in one range.  Streams of few rows are not cut and cost the
count of each stream's rows only.  Ranges have ``rows`` rows or more: a stream is cut into ``RANGES`` at most until
these have ``ROWS`` rows each, and only then into more.  The cuts of a stream and its summaries are as many as its
ranges: both are broadcast, and as every row is held against the cuts of its stream, these must not grow with the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.sources.datasets import stored

#: Rows of a range; ranges of a stream, while they have no more rows than that.
ROWS, RANGES = 1_000_000, 1000
_RANGE = "_range"


@dataclass(frozen=True)
class Measure:
    """What is carried along a stream: ``kind`` of ``value``; ``exclusive`` leaves the row itself out."""

    kind: str
    value: Column
    exclusive: bool = False
    order: tuple = ()


def total(value: Column | str, exclusive: bool = False) -> Measure:
    """The sum up to the row."""
    return Measure("total", F.col(value) if isinstance(value, str) else value, exclusive)


def highest(value: Column | str, exclusive: bool = False) -> Measure:
    """The largest value up to the row."""
    return Measure("highest", F.col(value) if isinstance(value, str) else value, exclusive)


def last(value: Column | str, exclusive: bool = False) -> Measure:
    """The last value that isn't null, up to the row."""
    return Measure("last", F.col(value) if isinstance(value, str) else value, exclusive)


def following(value: Column | str, *order: Column) -> Measure:
    """The next value that isn't null, from the row on; ``order`` is how rows are met backwards, if not simply so."""
    return Measure("following", F.col(value) if isinstance(value, str) else value, False, order)


def previous(value: Column | str) -> Measure:
    """The value of the row before, null or not."""
    return Measure("previous", F.col(value) if isinstance(value, str) else value)


def rank() -> Measure:
    """How many rows come before the row, rows of equal order not counted."""
    return Measure("rank", F.lit(1))


def range_rows(n: Column, rows: int) -> Column:
    """Rows of a range of a stream that has ``n`` of them."""
    return F.greatest(F.lit(rows), F.least(F.lit(ROWS), F.ceil(n / F.lit(RANGES))))


def beside(df: DataFrame, side: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Beside each row what the small ``side`` has for its keys; null keys are keys."""
    if not keys:
        return df.join(F.broadcast(side), F.lit(True), how)  # one row
    own = F.broadcast(side.withColumnsRenamed({k: f"_s_{k}" for k in keys}))
    return df.join(own, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys], how).drop(*[f"_s_{k}" for k in keys])


class Stream:
    """Rows of streams, in an order, to which measures are added; ``df`` has the rows with what was added."""

    def __init__(self, df: DataFrame, by: list[str], order: list[str], rows: int = ROWS) -> None:
        self.by, self.order = list(by), list(order)
        edges = self._edges(df, rows)
        self.split = edges is not None
        if self.split:
            own = beside(df, edges, self.by).withColumn(_RANGE, F.coalesce(_position(F.col("_edges"), F.col(self.order[0]), self.most) + 1, F.lit(0)))
            df = stored(own.drop("_edges"), "ranges")
        self._rows = df

    def _edges(self, df: DataFrame, rows: int) -> DataFrame | None:
        """Of streams with more than so many rows the quantiles of their order at which they are cut; None if there are none."""
        sizes = df.groupBy(*self.by).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows)
        sizes = stored(sizes, "sizes")
        parts = F.ceil(F.col("_n") / range_rows(F.col("_n"), rows))
        most = sizes.agg(F.max(parts).alias("most")).first()["most"]
        if most is None:
            return None
        self.most = most
        points = F.array(*[F.lit(i / most) for i in range(1, most)])
        long = beside(df.select(*self.by, F.col(self.order[0]).alias("_t")), sizes, self.by, "inner")
        every = long.groupBy(*self.by).agg(F.percentile_approx("_t", points, F.lit(max(10_000, 10 * most))).alias("_e"), F.first("_n").alias("_n"))
        # A shorter stream keeps each so-manieth of the cuts that the longest one needs.
        step = F.greatest(F.floor(F.lit(most) / parts), F.lit(1))
        kept = F.filter("_e", lambda e, i: (i + 1) % step == 0)
        return stored(every.select(*self.by, F.array_distinct(kept).alias("_edges")), "edges")

    @property
    def df(self) -> DataFrame:
        return self._rows.drop(_RANGE)

    def map(self, fn) -> Stream:
        """The stream after ``fn`` of its rows, which may drop rows and add columns, but not move rows."""
        new = object.__new__(Stream)
        new.__dict__ = self.__dict__ | {"_rows": fn(self._rows)}
        return new

    def add(self, **measures: Measure) -> Stream:
        """Each measure under its name."""
        part = [*self.by, _RANGE] if self.split else self.by
        ahead = Window.partitionBy(*part).orderBy(*self.order)
        local = {name: self._local(m, ahead, part) for name, m in measures.items()}
        if not self.split:
            return self.map(lambda df: df.withColumns({n: self._finished(measures[n], c, None) for n, c in local.items()}))
        # Structs, so that a null that is handed on differs from nothing handed on.
        at = F.struct(*self.order)
        sums = self._rows.filter(f"{_RANGE} > 0").groupBy(*part).agg(*[self._summary(m, at).alias(n) for n, m in measures.items()])
        turn = Window.partitionBy(*self.by).orderBy(_RANGE)
        before, after = turn.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*self.by).orderBy(F.desc(_RANGE)).rowsBetween(Window.unboundedPreceding, -1)
        carried = sums.select(*part, *[self._carry(m, n, turn, before, after).alias(f"_c_{n}") for n, m in measures.items()])
        rows = self._rows.withColumns({f"_l_{n}": c for n, c in local.items()})
        rows = beside(rows, carried, part)
        rows = rows.withColumns({n: self._finished(m, F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n, m in measures.items()})
        return self.map(lambda _: rows.drop(*[f"_{x}_{n}" for n in measures for x in "lc"]))

    def _local(self, m: Measure, ahead, part: list[str]) -> Column:
        upto = ahead.rowsBetween(Window.unboundedPreceding, -1 if m.exclusive else 0)
        if m.kind == "total":
            return F.sum(m.value).over(upto)
        if m.kind == "highest":
            return F.max(m.value).over(upto)
        if m.kind == "last":
            return F.last(m.value, ignorenulls=True).over(upto)
        if m.kind == "following":
            back = Window.partitionBy(*part).orderBy(*(m.order or [F.desc(c) for c in self.order]))
            return F.last(m.value, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
        if m.kind == "previous":
            return F.lag(F.struct(m.value.alias("v"))).over(ahead)
        return F.rank().over(ahead).cast("long") - 1

    @staticmethod
    def _summary(m: Measure, at: Column) -> Column:
        there = F.when(m.value.isNotNull(), at)
        if m.kind == "total":
            return F.sum(m.value)
        if m.kind == "highest":
            return F.max(m.value)
        if m.kind == "last":
            return F.max_by(m.value, there)
        if m.kind == "following":
            return F.min_by(m.value, there)
        return F.max_by(F.struct(m.value.alias("v")), at) if m.kind == "previous" else F.count("*")

    @staticmethod
    def _carry(m: Measure, name: str, turn, before, after) -> Column:
        if m.kind in ("total", "rank"):
            return F.sum(name).over(before)
        if m.kind == "highest":
            return F.max(name).over(before)
        if m.kind == "previous":
            return F.lag(name).over(turn)
        return F.last(name, ignorenulls=True).over(after if m.kind == "following" else before)

    @staticmethod
    def _finished(m: Measure, local: Column, carry: Column | None) -> Column:
        if m.kind == "previous":
            return (local if carry is None else F.coalesce(local, carry))["v"]
        if carry is None:
            return local
        if m.kind in ("total", "rank"):
            return F.coalesce(local + carry, local, carry)
        return F.greatest(local, carry) if m.kind == "highest" else F.coalesce(local, carry)


def _position(edges: Column, value: Column, most: int) -> Column:
    """How many of the sorted edges are below the value, by binary search."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, most.bit_length())))])
    nearer = lambda at, s: F.when(F.get(edges, at + s - 1) < value, at + s).otherwise(at)
    return F.when(edges.isNotNull(), F.aggregate(steps, F.lit(0), nearer))
