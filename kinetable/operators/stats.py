"""Feature statistics: scalar and per-dimension, mergeable, and robust ones for offsets and drifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.functions.values import finite, not_nan
from kinetable.operators.longstreams import Stream, total
from kinetable.sources.datasets import stored

QUANTILES = {"q01": 0.01, "q10": 0.1, "q50": 0.5, "q90": 0.9, "q99": 0.99}


#: Values of a group whose quantiles one task finds; beyond that they are found through histograms, with equal results.
MOST, BINS, ACCURACY = 1_000_000, 64, 10_000


def moments(x: Column) -> list[Column]:
    """NaN is skipped, infinities count; the deviation is the population's."""
    v = not_nan(x)
    return [F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("count")]


def quantiles(df: DataFrame, keys: list[str], value: Column | str, points: dict[str, float], most: int = MOST) -> DataFrame:
    """The keys and, under the names of ``points``, exact interpolated quantiles of the finite values of each group.

    Groups of up to ``most`` values are one aggregate.  The values at the wanted ranks of larger ones are found by ever
    finer histograms: bins of about equal counts are counted, and only the bins that hold a wanted rank are divided again.
    Null keys are keys like any other; groups without a finite value are left out.
    """
    rows = df.select(*keys, finite(value).cast("double").alias("_v")).filter("_v is not null")
    every = F.percentile("_v", F.array(*map(F.lit, points.values())))
    named = [F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(points)]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    large = sizes.filter(F.col("_n") > most)
    if large.isEmpty():
        return rows.groupBy(*keys).agg(every.alias("_q")).select(*keys, *named)
    own = F.xxhash64(*keys, F.lit(0)) if keys else F.lit(0).cast("long")
    rows, large = rows.withColumn("_path", own), large.withColumn("_path", own)
    small = rows.join(F.broadcast(large.select("_path")), "_path", "left_anti").groupBy(*keys).agg(every.alias("_q"))
    # A target is a rank, from 0, within the rows of its path.
    ranks = F.explode(F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("_n") - 1) * q), F.ceil((F.col("_n") - 1) * q)) for q in points.values()]))))
    targets = large.select(*keys, "_path", "_n", ranks.alias("_rank")).withColumn("_left", F.col("_rank"))
    part, found = rows.select("_path", "_v"), None
    while True:
        edges = part.groupBy("_path").agg(F.percentile_approx("_v", F.array(*[F.lit(i / BINS) for i in range(1, BINS)]), F.lit(ACCURACY)).alias("_e"))
        part = part.join(F.broadcast(edges), "_path")  # as many rows as there are wanted bins
        part = part.withColumn("_bin", F.size(F.filter("_e", lambda e: e < F.col("_v")))).drop("_e")
        bins = part.groupBy("_path", "_bin").agg(F.count("*").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        bins = bins.withColumn("_upto", F.sum("_c").over(Window.partitionBy("_path").orderBy("_bin")))
        hit = targets.join(bins, "_path").filter((F.col("_left") < F.col("_upto")) & (F.col("_left") >= F.col("_upto") - F.col("_c")))
        hit = hit.withColumn("_left", F.col("_left") - F.col("_upto") + F.col("_c"))
        hit = stored(hit.select(*keys, "_path", "_n", "_rank", "_left", "_bin", "_c", "_low", "_high"), "ranks")
        done = hit.filter("_low = _high").select(*keys, "_n", "_rank", F.col("_low").alias("_x"))
        found = done if found is None else found.union(done)
        open_ = hit.filter("_low < _high")
        deeper = F.xxhash64("_path", "_bin")
        wanted = open_.select("_path", "_bin").distinct()
        part = part.join(F.broadcast(wanted), ["_path", "_bin"], "left_semi").select(deeper.alias("_path"), "_v")
        targets = open_.withColumn("_path", deeper).drop("_bin", "_low", "_high")
        if open_.filter(F.col("_c") > most).isEmpty():
            break
        targets = targets.drop("_c")
    upto = part.groupBy("_path", "_v").agg(F.count("*").alias("_c")).withColumn("_upto", F.sum("_c").over(Window.partitionBy("_path").orderBy("_v")))
    last = targets.drop("_c").join(upto, "_path").filter((F.col("_left") < F.col("_upto")) & (F.col("_left") >= F.col("_upto") - F.col("_c")))
    found = found.union(last.select(*keys, "_n", "_rank", F.col("_v").alias("_x")))
    at = found.groupBy(*keys, "_n").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_at"))

    def between(q: float) -> Column:
        h = (F.col("_n") - 1) * q
        low, high = F.element_at("_at", F.floor(h)), F.element_at("_at", F.ceil(h))
        return low + (h - F.floor(h)) * (high - low)

    big = at.select(*keys, F.array(*[between(q) for q in points.values()]).alias("_q"))
    return small.filter("_q is not null").unionByName(big).select(*keys, *named)


def quantiles_of_all(df: DataFrame, keys: list[str], value: Column, points: dict[str, float], *others: Column, most: int = MOST) -> DataFrame:
    """The keys, ``quantiles`` and ``others`` of every group; those of a group without a value are null."""
    rows = df.withColumn("_q", finite(value).cast("double"))
    if rows.groupBy(*keys).agg(F.count("_q").alias("_n")).filter(F.col("_n") > most).isEmpty():
        every = F.percentile("_q", F.array(*map(F.lit, points.values())))
        out = rows.groupBy(*keys).agg(every.alias("_p"), *others)
        return out.withColumns({n: F.get("_p", F.lit(i)) for i, n in enumerate(points)}).drop("_p")
    return with_columns_of(rows.groupBy(*keys).agg(F.count("*").alias("_n"), *others).drop("_n"), quantiles(rows, keys, "_q", points, most), keys, "left")


def _in_order(df: DataFrame, keys: list[str], order: list, rows: int | None) -> DataFrame:
    """Adds ``_i``, the number of a row within its group, from 1, and ``_n``, how many there are; with ``rows`` over
    ranges of longer groups."""
    if not rows:
        w = Window.partitionBy(*keys)
        return df.withColumn("_i", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    counted = Stream(df, keys, order, rows).add(_i=total(F.lit(1))).df
    return with_columns_of(counted, df.groupBy(*keys).agg(F.count("*").alias("_n")), keys)


def with_columns_of(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows of equal keys, nulls among them; the right side has one for each."""
    if not keys:
        return left.join(F.broadcast(right), F.lit(True), how)  # one row
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(r, same, how).drop(*[f"_r_{k}" for k in keys])


def scalar_stats(df: DataFrame, keys: list[str], value: str, quantiles_too: bool = True, most: int = MOST, sizes: DataFrame | None = None) -> DataFrame:
    """mean, std, min, max, quantiles and count of each group; groups without a finite value are left out.

    All is one aggregate unless a group (as ``sizes`` with ``count`` say, if given) has more than ``most`` rows.
    """
    v, own = finite(value).cast("double"), moments(F.col(value))
    sizes = df.groupBy(*keys).count() if quantiles_too and sizes is None else sizes
    small = quantiles_too and sizes.filter(F.col("count") > most).isEmpty()
    every = [F.percentile(v, F.array(*map(F.lit, QUANTILES.values()))).alias("_q")] if small else []
    out = df.groupBy(*keys).agg(*own, F.count(v).alias("_finite"), *every).filter("_finite > 0")
    if not quantiles_too:
        return out.drop("_finite")
    if small:
        out = out.select("*", *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(QUANTILES)])
    else:
        out = with_columns_of(out, quantiles(df, keys, value, QUANTILES, most), keys)
    return out.select(*keys, "mean", "std", "min", "max", *QUANTILES, "count")


def vector_stats(df: DataFrame, keys: list[str], vector: str, most: int = MOST) -> DataFrame:
    """One row per dimension; ``count`` is of vectors that are finite throughout.  Groups of ragged vectors are left out.

    For a few thousand dimensions at most: each value becomes a row.
    """
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sized = df.groupBy(*keys).agg(F.min(F.size(vector)).alias("_a"), F.max(F.size(vector)).alias("_z"), F.count_if(fine).alias("count"))
    cells = df.select(*keys, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    # No dimension of a group has more values than the group has vectors.
    out = scalar_stats(cells, [*keys, "dim"], "x", True, most, df.groupBy(*keys).count()).drop("count")
    return with_columns_of(out, sized.filter("_a = _z").drop("_a", "_z"), keys)


def blocks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Statistics in a form that can be added up: n, sum, sum of squares, min, max."""
    v = not_nan(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"), F.min(v).alias("low"), F.max(v).alias("high"))


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of parts as blocks of the whole."""
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")], F.min("low").alias("low"), F.max("high").alias("high"))


def from_blocks(whole: DataFrame) -> DataFrame:
    """mean, std, min, max and count of blocks; an empty block has mean 0 and deviation 1."""
    keys = [c for c in whole.columns if c not in ("n", "total", "squares", "low", "high")]
    mean = F.col("total") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0)))
    empty = F.col("n") == 0
    return whole.select(*keys, F.when(empty, 0.0).otherwise(mean).alias("mean"), F.when(empty, 1.0).otherwise(spread).alias("std"), F.col("low").alias("min"), F.col("high").alias("max"), F.col("n").alias("count"))


def to_blocks(stats: DataFrame, keys: list[str]) -> DataFrame:
    """The way back, from mean, std (population), min, max and count."""
    n, m, s = F.col("count"), F.col("mean"), F.col("std")
    return stats.select(*keys, n.alias("n"), (n * m).alias("total"), (n * (s * s + m * m)).alias("squares"), F.col("min").alias("low"), F.col("max").alias("high"))


def vector_blocks(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Blocks of each dimension of wide vectors, summed up within each task without a row for every value."""
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    schema = ", ".join([*(f"`{k}` {t}" for k, t in df.select(*keys).dtypes), "dim int, n bigint, total double, squares double, low double, high double"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, own in pdf.groupby(keys, dropna=False) if keys else [((), pdf)]:
                x = np.stack(own[vector].to_numpy()).astype(float)
                fine = ~np.isnan(x)
                n = fine.sum(0)
                out = pd.DataFrame({"dim": np.arange(x.shape[1]), "n": n, "total": np.where(fine, x, 0).sum(0), "squares": np.where(fine, x * x, 0).sum(0), "low": np.where(n > 0, np.where(fine, x, np.inf).min(0), np.nan), "high": np.where(n > 0, np.where(fine, x, -np.inf).max(0), np.nan)})
                for k, v in zip(keys, key, strict=True):
                    out[k] = v
                yield out[[*keys, "dim", "n", "total", "squares", "low", "high"]]

    rows = df.filter(F.col(vector).isNotNull()).select(*keys, vector).mapInPandas(add, schema)
    return merged(rows, [*keys, "dim"])


def histogram_quantiles(df: DataFrame, keys: list[str], code: str, quantiles: dict[str, float]) -> DataFrame:
    """Quantiles of small integers from their counts: the first code up to which more than q n are counted."""
    counts = df.groupBy(*keys, F.col(code).alias("code")).agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys).orderBy("code")))
    whole = upto.withColumn("all", F.max("upto").over(Window.partitionBy(*keys)))
    return whole.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") > F.col("all") * q, F.col("code"))).alias(name) for name, q in quantiles.items()], F.max("all").alias("count"))


def robust(df: DataFrame, keys: list[str], value: str, most: int = MOST) -> DataFrame:
    points = {"median": 0.5, "p25": 0.25, "p75": 0.75, "p10": 0.1, "p90": 0.9}
    q = quantiles(df, keys, value, points, most)
    n = df.groupBy(*keys).agg(F.count(finite(value)).alias("n")).filter("n > 0")
    return with_columns_of(q, n, keys).select(*keys, *points, (F.col("p75") - F.col("p25")).alias("iqr"), "n")


def drift_ppm(df: DataFrame, keys: list[str], x: str, y: str, least: int = 8) -> DataFrame:
    """Slope of y over x in millionths, from so many points at least, and the fit's determination."""
    out = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n"))
    fits = F.col("n") >= least
    return out.select(*keys, F.when(fits, F.col("slope") * 1e6).alias("drift_ppm"), F.when(fits, F.col("r2")).alias("r2"), "n")


def segment_steps(df: DataFrame, keys: list[str], order: list, value: str, parts: int = 20, rows: int | None = None, most: int = MOST) -> DataFrame:
    """The largest step between the medians of equal parts of a series."""
    # The first parts have one row more than the others where they don't come out even.
    size, more = F.floor(F.col("_n") / parts), F.col("_n") % parts
    longer = more * (size + 1)
    part = F.when(F.col("_i") <= longer, F.floor((F.col("_i") - 1) / (size + 1))).otherwise(more + F.floor((F.col("_i") - 1 - longer) / F.greatest(size, F.lit(1))))
    cut = _in_order(df, keys, order, rows).withColumn("part", (part + 1).cast("int"))
    mid = quantiles_of_all(cut, [*keys, "part"], F.col(value), {"mid": 0.5}, most=most)
    step = mid.withColumn("step", F.abs(F.col("mid") - F.lag("mid").over(Window.partitionBy(*keys).orderBy("part"))))
    return step.groupBy(*keys).agg(F.max("step").alias("largest_step"), F.count("*").alias("parts"))


def growth(df: DataFrame, keys: list[str], order: list, value: str, buckets: int = 8, rows: int | None = None, most: int = MOST) -> DataFrame:
    """Medians of equally many values in turn, with the slope and determination over the buckets."""
    size = F.greatest(F.lit(1), F.floor(F.col("_n") / buckets))
    b = F.least(F.floor((F.col("_i") - 1) / size), F.lit(buckets - 1))
    mid = quantiles_of_all(_in_order(df, keys, order, rows).withColumn("bucket", b.cast("int")), [*keys, "bucket"], F.col(value), {"mid": 0.5}, most=most)
    return mid.groupBy(*keys).agg(F.regr_slope("mid", "bucket").alias("slope"), F.regr_r2("mid", "bucket").alias("r2"), F.count("*").alias("buckets"))


def half_drift(df: DataFrame, keys: list[str], order: list, value: str, least: int = 20, rows: int | None = None, most: int = MOST) -> DataFrame:
    """Median of the second half less that of the first, of so many rows at least."""
    numbered = _in_order(df, keys, order, rows).filter(F.col("_n") >= least).withColumn("_late", F.col("_i") > F.floor(F.col("_n") / 2))
    mid = quantiles_of_all(numbered, [*keys, "_late"], F.col(value), {"mid": 0.5}, most=most)
    both = mid.groupBy(*keys).agg(F.max(F.when(~F.col("_late"), F.col("mid"))).alias("first"), F.max(F.when(F.col("_late"), F.col("mid"))).alias("second"))
    return both.withColumn("drift", F.col("second") - F.col("first"))


def scale_of(df: DataFrame, keys: list[str], total: str, force: str, least_force: float = 50.0, least_rows: int = 5, most: int = MOST) -> DataFrame:
    """By how much stored forces were scaled: the nearest of 1, 10, 100 and 1000 within 3 %, else 1 up to 1.15, else null."""
    ratio = F.when(F.abs(force) >= least_force, F.col(total) / F.col(force))
    out = quantiles_of_all(df, keys, ratio, {"ratio": 0.5}, F.count(ratio).alias("n"), most=most)
    near = F.coalesce(*[F.when(F.abs(F.col("ratio") / s - 1) <= 0.03, s) for s in (1, 10, 100, 1000)], F.when(F.col("ratio") <= 1.15, 1))
    return out.select(*keys, "ratio", "n").withColumn("scale", F.when(F.col("n") >= least_rows, near))


def display_range(df: DataFrame, keys: list[str], value: str, floor: float = 0.01, span: float = 0.5, most: int = MOST) -> DataFrame:
    """From the median to 1.3 times the 99.9th percentile of values above the floor, never narrower than ``span``."""
    out = quantiles_of_all(df, keys, F.when(F.col(value) > floor, F.col(value)), {"low": 0.5, "_top": 0.999}, most=most)
    return out.select(*keys, "low", F.greatest(F.col("_top") * 1.3, F.col("low") + span).alias("high"))
