"""Runs, gaps and islands: stretches of like rows, dense times, covered and free ranges.

With ``rows`` streams that are longer than that are cut into ranges (``longstreams``), so that no stream is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.operators.longstreams import Stream, following, highest, last, previous, rank, total


def numbered(df: DataFrame, by: list[str], order: list, starts: Column) -> DataFrame:
    """Adds ``run``: how many rows up to this one start a run."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_start", F.coalesce(starts, F.lit(True)).cast("int")).withColumn("run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def runs_of(df: DataFrame, by: list[str], order: list, value: str, index: str, least: int = 1, rows: int | None = None) -> DataFrame:
    """Stretches of equal values (null equals null): value, first and last index, length."""
    if rows:
        s = Stream(df, by, order, rows).add(_prev=previous(F.struct(F.col(value).alias("v"))))
        new = F.col("_prev").isNull() | ~F.col(value).eqNullSafe(F.col("_prev.v"))
        runs = s.add(run=total(new.cast("int"))).df
    else:
        runs = _numbered_runs(df, by, order, value)
    out = runs.groupBy(*by, "run").agg(F.first(value).alias(value), F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("length"))
    return out.filter(F.col("length") >= least).drop("run")


def _numbered_runs(df: DataFrame, by: list[str], order: list, value: str) -> DataFrame:
    prev = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    first = F.lag(F.lit(1)).over(Window.partitionBy(*by).orderBy(*order)).isNull()
    return numbered(df, by, order, first | ~F.col(value).eqNullSafe(prev))


def frozen(df: DataFrame, by: list[str], order: list, array: str, index: str, warn: int = 40, fail: int = 300, rows: int | None = None) -> DataFrame:
    """Runs of an array that repeats and isn't all zero."""
    alive = F.exists(array, lambda x: x != 0)
    runs = runs_of(df, by, order, array, index, warn, rows).filter(alive)
    return runs.withColumn("status", F.when(F.col("length") >= fail, "fail").otherwise("warn")).drop(array)


def merged_ranges(df: DataFrame, by: list[str], start: str, end: str, slack: float = 0.0, rows: int | None = None) -> DataFrame:
    """Ranges that overlap or come within ``slack`` as one."""
    if rows:
        s = Stream(df, by, [start, end], rows).add(_reach=highest(end, exclusive=True))
        new = F.coalesce(F.col(start) > F.col("_reach") + slack, F.lit(True)) if slack else F.coalesce(F.col(start) > F.col("_reach"), F.lit(True))
        joined = s.add(run=total(new.cast("int"))).df
        return joined.groupBy(*by, "run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts")).drop("run")
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    joined = numbered(df, by, [start, end], F.col(start) > reach + slack) if slack else numbered(df, by, [start, end], F.col(start) > reach)
    return joined.groupBy(*by, "run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts")).drop("run")


def coverage(df: DataFrame, by: list[str], start: str, end: str, total: Column) -> DataFrame:
    """Of inclusive frame ranges: frames covered, share, gaps between, overlaps, and ranges that end before they begin.

    The share is of ``total`` frames and has six places.
    """
    bad = df.groupBy(*by).agg(F.count_if(F.col(end) < F.col(start)).alias("invalid"), total.alias("total"))
    good = df.filter(F.col(end) >= F.col(start))
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = good.withColumn("_r", reach)
    new = F.greatest(F.col(end) - F.greatest(F.col(start) - 1, F.coalesce("_r", F.col(start) - 1)), F.lit(0))
    sums = own.groupBy(*by).agg(F.sum(new).alias("covered"), F.count_if(F.col(start) > F.col("_r") + 1).alias("gaps"), F.count_if(F.col(start) <= F.col("_r")).alias("overlaps"))
    out = bad.join(sums, by, "left").fillna(0, ["covered", "gaps", "overlaps"])
    return out.withColumn("ratio", F.bround(F.try_divide(F.col("covered"), F.col("total")), 6))


def _ahead(df: DataFrame, by: list[str], ts: str, width: int, rows: int) -> DataFrame:
    """Each row's keys and time, and how many rows are within ``width`` from it on: what is counted up to the end of
    that, less what is counted before the row."""
    ranked = Stream(df.select(*by, ts), by, [ts], rows).add(_before=rank()).df
    ends = ranked.select(*by, (F.col(ts) + width).alias("_t"), F.lit(1).alias("_side"), F.lit(0).alias("_one"), F.col(ts).alias("_ts"), "_before")
    own = ranked.select(*by, F.col(ts).alias("_t"), F.lit(0).alias("_side"), F.lit(1).alias("_one"))
    both = Stream(own.unionByName(ends, allowMissingColumns=True), by, ["_t", "_side"], rows).add(_upto=total("_one"))
    return both.df.filter("_side = 1").select(*by, F.col("_ts").alias(ts), (F.col("_upto") - F.col("_before")).alias("n"))


def density(df: DataFrame, by: list[str], ts: str, width: int, rows: int | None = None) -> DataFrame:
    """The most rows within ``width`` from any row on, and when."""
    if rows:
        found = _ahead(df.filter(F.col(ts).isNotNull()), by, ts, width, rows)
        return found.groupBy(*by).agg(F.max("n").alias("most"), F.max_by(ts, F.struct(F.col("n"), -F.col(ts))).alias("since"))
    n = F.count("*").over(Window.partitionBy(*by).orderBy(ts).rangeBetween(0, width))
    counted = df.withColumn("n", n)
    return counted.groupBy(*by).agg(F.max("n").alias("most"), F.max_by(ts, F.struct(F.col("n"), -F.col(ts))).alias("since"))


def floods(df: DataFrame, by: list[str], ts: str, width: int, least: int, gap: int, rows: int | None = None) -> DataFrame:
    """Times with ``least`` rows or more within ``width``, as stretches that are no more than ``gap`` apart."""
    if rows:
        s = Stream(_ahead(df.filter(F.col(ts).isNotNull()), by, ts, width, rows), by, [ts], rows)
        s = s.add(_dense=last(F.when(F.col("n") >= least, F.col(ts)))).map(lambda d: d.filter(F.col("_dense") >= F.col(ts) - width))
        s = s.add(_prev=previous(ts)).add(run=total(F.coalesce(F.col(ts) - F.col("_prev") > gap, F.lit(True)).cast("int")))
        return s.df.groupBy(*by, "run").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("rows")).drop("run")
    w = Window.partitionBy(*by).orderBy(ts)
    near = df.withColumn("_n", F.count("*").over(w.rangeBetween(0, width))).withColumn("_m", F.count("*").over(w.rangeBetween(-width, 0)))
    # A row belongs to a dense window if that begins at it or at an earlier row.
    start = F.max(F.when(F.col("_n") >= least, F.col(ts))).over(w.rangeBetween(-width, 0))
    dense = near.withColumn("_d", start).filter("_d is not null").drop("_n", "_m", "_d")
    runs = numbered(dense, by, [ts], F.col(ts) - F.lag(ts).over(w) > gap)
    return runs.groupBy(*by, "run").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("rows")).drop("run")


def changes(df: DataFrame, by: list[str], order: list, value: str) -> DataFrame:
    """How often a value changes, its distinct values in the order they come first, and blanks."""
    w = Window.partitionBy(*by).orderBy(*order)
    s = df.withColumn("_p", F.lag(value).over(w)).withColumn("_i", F.row_number().over(w))
    firsts = s.filter(F.trim(F.coalesce(value, F.lit(""))) != "").groupBy(*by, value).agg(F.min("_i").alias("_i"))
    names = firsts.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", value))), lambda x: x[value]), ",").alias("statuses"), F.count("*").alias("distinct"))
    n = s.groupBy(*by).agg(F.count_if(F.col(value) != F.col("_p")).alias("changes"), F.count_if(F.trim(F.coalesce(value, F.lit(""))) == "").alias("blank"))
    return n.join(names, by, "left").fillna(0, ["distinct"])


def edges(df: DataFrame, by: list[str], order: list, on: Column) -> DataFrame:
    """Rows at which a condition turns true (``grasp``) or false (``open``); the first row counts if true."""
    w = Window.partitionBy(*by).orderBy(*order)
    s = df.withColumn("_on", F.coalesce(on, F.lit(False)))
    s = s.withColumn("_p", F.coalesce(F.lag("_on").over(w), F.lit(False))).filter("_on <> _p")
    return s.withColumn("kind", F.when(F.col("_on"), "grasp").otherwise("open")).drop("_on", "_p")


def pressure_edges(df: DataFrame, by: list[str], order: list, value: str, share: float = 0.15) -> DataFrame:
    """Crossings of a share of the stream's largest value."""
    top = F.max(value).over(Window.partitionBy(*by))
    return edges(df.withColumn("_top", top), by, order, (F.col("_top") > 0) & (F.col(value) > share * F.col("_top"))).drop("_top")


def interpolated(df: DataFrame, by: list[str], order: str, value: str, rows: int | None = None) -> DataFrame:
    """Nulls in ``value`` filled on the line between the values around them, at the ends with the nearest, else with 0."""
    w = Window.partitionBy(*by)
    at = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("t"), F.col(value).alias("v")))
    if rows:
        s = Stream(df, by, [order], rows).add(_a=last(at), _z=following(at)).df
    else:
        s = df.withColumn("_a", F.last(at, ignorenulls=True).over(w.orderBy(order))).withColumn("_z", F.last(at, ignorenulls=True).over(w.orderBy(F.desc(order))))
    share = F.when(F.col("_z.t") == F.col("_a.t"), 0.0).otherwise((F.col(order) - F.col("_a.t")) / (F.col("_z.t") - F.col("_a.t")))
    line = F.col("_a.v") + share * (F.col("_z.v") - F.col("_a.v"))
    return s.withColumn("filled", F.coalesce(F.col(value), line, F.col("_a.v"), F.col("_z.v"), F.lit(0.0))).drop("_a", "_z")


def recovery(df: DataFrame, by: list[str], order: list, ok: str, streak: int = 10) -> DataFrame:
    """Share of good rows, and the first row from which ``streak`` in a row are good."""
    w = Window.partitionBy(*by).orderBy(*order)
    s = df.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count_if(ok).over(w.rowsBetween(0, streak - 1)))
    return s.groupBy(*by).agg(F.avg(F.col(ok).cast("double")).alias("share"), F.min(F.when(F.col(ok), F.col("_i"))).alias("first_ok"), F.min(F.when(F.col("_n") == streak, F.col("_i"))).alias("recovered"))


def last_valid(df: DataFrame, keys: list[str], seq: str, values: list[str]) -> DataFrame:
    """Repeated rows as one: of each column the last value that is there and not NaN."""
    kinds = dict(df.dtypes)
    fine = lambda c: F.col(c).isNotNull() & (~F.isnan(c) if kinds[c] in ("double", "float") else F.lit(True))
    return df.groupBy(*keys).agg(*[F.max_by(c, F.when(fine(c), F.col(seq))).alias(c) for c in values])


def histogram_of_lengths(runs: DataFrame, by: list[str], length: str = "length") -> DataFrame:
    """Runs by length: 1, 2-5, 6-10, 11-15, longer; and the longest."""
    n = F.col(length)
    label = F.when(n <= 1, "1").when(n <= 5, "2-5").when(n <= 10, "6-10").when(n <= 15, "11-15").otherwise(">15")
    return runs.groupBy(*by, label.alias("band")).agg(F.count("*").alias("runs"), F.max(length).alias("longest"))
