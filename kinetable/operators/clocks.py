"""Timestamp checks and repairs of ordered streams: one window over each stream, no shuffle beyond its key.

With ``rows`` streams that are longer than that are cut into ranges (``longstreams``), so that no stream is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.functions.values import unwrapped_step
from kinetable.operators.longstreams import Stream, last, previous, total
from kinetable.operators.stats import quantiles_of_all, with_columns_of

# Fixed thresholds of the timestamp checks.
JUMP, JUMP_EXCESS_NS, COMPRESSED = 1.8, 3_000_000, 0.5
JUMP_ERROR, JUMP_ERRORS, BURSTY_P95, BURSTY_ERROR = 5.0, 10, 1.5, 1.34
DUPLICATE_SHARE = 0.001
RATE_WARN, RATE_ERROR, COVERAGE = 0.01, 0.05, 0.95


def steps(df: DataFrame, by: list[str], order: list, ts: str, rows: int | None = None) -> DataFrame:
    """Adds ``prev`` and ``step`` to the rows of each stream."""
    if rows:
        return Stream(df, by, order, rows).add(prev=previous(ts)).df.withColumn("step", F.col(ts) - F.col("prev"))
    prev = F.lag(ts).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("prev", prev).withColumn("step", F.col(ts) - F.col("prev"))


def gap_flags(df: DataFrame, by: list[str], index: str) -> DataFrame:
    """``gap_before``: whether the row before isn't the one with the number before; not so for the first."""
    prev = F.lag(index).over(Window.partitionBy(*by).orderBy(index))
    return df.withColumn("gap_before", F.coalesce(prev != F.col(index) - 1, F.lit(False)))


def regressions(df: DataFrame, by: list[str], order: list, ts: str, wrap_bits: int | None = None, rows: int | None = None) -> DataFrame:
    """Backward steps of each stream; steps that a counter's wrap-around explains are counted apart."""
    s = steps(df, by, order, ts, rows)
    back = F.col("step") < 0
    wrapped = back & (unwrapped_step(F.col("step"), wrap_bits) >= 0) if wrap_bits else F.lit(False)
    return s.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(back & ~wrapped).alias("regressions"), F.count_if(wrapped).alias("wraps"), F.max(F.when(back & ~wrapped, -F.col("step"))).alias("worst"))


def duplicates(df: DataFrame, by: list[str], order: list, ts: str, quantum: int = 1, row: str | None = None) -> DataFrame:
    """Steps smaller than the clock's quantum; an error if two stand in one row, or if they are more than a thousandth."""
    s = steps(df, by, order, ts)
    same = F.abs("step") <= quantum - 1
    inner = same & (F.col(row) == F.lag(row).over(Window.partitionBy(*by).orderBy(*order))) if row else F.lit(False)
    s = s.withColumn("_same", F.coalesce(same, F.lit(False))).withColumn("_inner", F.coalesce(inner, F.lit(False)))
    out = s.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if("_same").alias("duplicates"), F.count_if("_inner").alias("within_rows"))
    bad = (F.col("within_rows") > 0) | (F.col("duplicates") / F.greatest(F.col("rows") - 1, F.lit(1)) > DUPLICATE_SHARE)
    return out.withColumn("severity", F.when(F.col("duplicates") == 0, "info").when(bad, "error").otherwise("warn"))


def jumps(df: DataFrame, by: list[str], order: list, ts: str, nominal: Column | None = None, bursty: bool = False, rows: int | None = None) -> DataFrame:
    """Gaps beyond the nominal period (the median step unless given) and compressed steps.

    Streams that arrive in bursts are held against their own 95th percentile instead.
    """
    s = steps(df, by, order, ts, rows).filter("step is not null")
    points = {"nominal": 0.5, "p95": 0.95}
    if rows:
        base = quantiles_of_all(s, by, F.col("step"), points, *([] if nominal is None else [nominal.alias("_given")]), most=rows)
        s = with_columns_of(s, base if nominal is None else base.withColumn("nominal", F.col("_given")).drop("_given"), by)
    else:
        base = s.groupBy(*by).agg((nominal if nominal is not None else F.percentile("step", F.lit(0.5))).alias("nominal"), F.percentile("step", F.lit(0.95)).alias("p95"))
        s = s.join(base, by)
    floor = F.greatest(F.col("nominal") * JUMP, F.col("p95") * BURSTY_P95) if bursty else F.col("nominal") * JUMP
    gap = (F.col("step") > floor) & (F.col("step") - F.col("nominal") >= JUMP_EXCESS_NS)
    out = s.groupBy(*by).agg(F.first("nominal").alias("nominal"), F.first(floor).alias("floor"), F.count_if(gap).alias("gaps"), F.count_if(F.col("step") < F.col("nominal") * COMPRESSED).alias("compressed"), F.max(F.when(gap, F.col("step"))).alias("largest"))
    high = F.col("floor") * BURSTY_ERROR if bursty else F.col("nominal") * JUMP_ERROR
    bad = (F.col("largest") >= high) | (F.col("gaps") >= JUMP_ERRORS)
    return out.withColumn("severity", F.when(F.col("gaps") == 0, "info").when(bad, "error").otherwise("warn")).drop("floor")


def counts(df: DataFrame, by: list[str], order: list, samples: str) -> DataFrame:
    """Rows without samples (inside the recording and at its ends), and rows with a burst of them."""
    w = Window.partitionBy(*by)
    n = F.coalesce(F.size(samples), F.lit(0))
    s = df.withColumn("n", F.greatest(n, F.lit(0))).withColumn("_i", F.row_number().over(w.orderBy(*order)))
    s = s.withColumn("_a", F.min(F.when(F.col("n") > 0, F.col("_i"))).over(w)).withColumn("_z", F.max(F.when(F.col("n") > 0, F.col("_i"))).over(w))
    mid = s.groupBy(*by).agg(F.percentile(F.when(F.col("n") > 0, F.col("n")), F.lit(0.5)).alias("median"))
    s = s.join(mid, by)
    empty, inside = F.col("n") == 0, F.col("_i").between(F.col("_a"), F.col("_z"))
    burst = F.col("n") > F.greatest(3 * F.col("median"), F.col("median") + 3)
    return s.groupBy(*by).agg(F.count("*").alias("rows"), F.sum("n").alias("samples"), F.count_if(empty & F.coalesce(inside, F.lit(False))).alias("empty_inside"), F.count_if(empty & ~F.coalesce(inside, F.lit(False))).alias("empty_edge"), F.count_if(burst).alias("bursts"))


def rate_and_coverage(df: DataFrame, by: list[str], ts: str, rate: Column, span: Column) -> DataFrame:
    """Samples against those that the rate (per unit of ts) lets expect over the span, and the share of it covered."""
    out = df.groupBy(*by).agg(F.count(ts).alias("samples"), (F.max(ts) - F.min(ts)).alias("own_span"), rate.alias("rate"), span.alias("span"))
    out = out.withColumn("expected", F.col("rate") * F.col("span") + 1).withColumn("deviation", F.col("samples") / F.col("expected") - 1).withColumn("coverage", F.col("own_span") / F.col("span"))
    off = F.abs("deviation")
    severity = F.when(off > RATE_ERROR, "error").when((off > RATE_WARN) | (F.col("coverage") < COVERAGE), "warn").otherwise("info")
    return out.withColumn("severity", severity)


def frame_contract(df: DataFrame, by: list[str], index: str) -> DataFrame:
    """Frame numbers have to run from 0 to one less than the rows, each once."""
    out = df.groupBy(*by).agg(F.count("*").alias("rows"), F.min(index).alias("first"), F.max(index).alias("last"), F.countDistinct(index).alias("distinct"))
    return out.withColumn("ok", (F.col("first") == 0) & (F.col("last") == F.col("rows") - 1) & (F.col("distinct") == F.col("rows")))


def holes(df: DataFrame, index: str, width: int = 100_000) -> DataFrame:
    """Numbers missing between the smallest and the largest, as ranges, and numbers that occur more than once."""
    n = df.groupBy(F.col(index).alias("i")).agg(F.count("*").alias("n"))
    # The number before each: within a block by a window, across blocks by a window over one row for each block.
    n = n.withColumn("b", F.floor(F.col("i") / width))
    edge = n.groupBy("b").agg(F.max("i").alias("last"))
    edge = edge.select("b", F.lag("last").over(Window.orderBy("b")).alias("before"))
    w = Window.partitionBy("b").orderBy("i")
    n = n.withColumn("prev", F.lag("i").over(w)).join(edge, "b").withColumn("prev", F.coalesce("prev", "before"))
    missing = n.filter(F.col("i") > F.col("prev") + 1).select(F.lit("missing").alias("kind"), (F.col("prev") + 1).alias("first"), (F.col("i") - 1).alias("last"))
    return missing.unionByName(n.filter("n > 1").select(F.lit("repeated").alias("kind"), F.col("i").alias("first"), F.col("i").alias("last")))


def gap_watch(df: DataFrame, by: list[str], order: list, ts: str, nominal: float, least: float, rows: int | None = None) -> DataFrame:
    """Time lost beyond the nominal period; a backward step starts anew, time 0 is no reading."""
    s = steps(df.filter(F.col(ts) != 0), by, order, ts, rows)
    lost = F.when((F.col("step") > 0) & (F.col("step") - nominal >= least), F.col("step") - nominal)
    return s.groupBy(*by).agg(F.count("*").alias("readings"), F.count(lost).alias("gaps"), F.coalesce(F.sum(lost), F.lit(0)).alias("lost"), F.max(lost).alias("peak"), F.count_if(F.col("step") < 0).alias("resyncs"))


def stalls(df: DataFrame, by: list[str], order: list, ts: str, ok: str) -> DataFrame:
    """Stretches of failed reads, up to the next good one or to the last row if none follows."""
    w = Window.partitionBy(*by).orderBy(*order)
    s = df.withColumn("_start", (~F.col(ok) & F.coalesce(F.lag(ok).over(w), F.lit(True))).cast("int")).withColumn("_run", F.sum("_start").over(w))
    s = s.withColumn("_next", F.lead(ts).over(w)).filter(~F.col(ok))
    runs = s.groupBy(*by, "_run").agg((F.max(F.coalesce("_next", ts)) - F.min(ts)).alias("stall"))
    return runs.groupBy(*by).agg(F.count("*").alias("stalls"), F.sum("stall").alias("stalled"), F.max("stall").alias("longest"))


def unwrapped(df: DataFrame, by: list[str], order: list, ts: str, bits: int = 32, rows: int | None = None) -> DataFrame:
    """A counter that goes on through its wrap-arounds, in ``unwrapped``; missing readings have none and are stepped over."""
    if rows:
        s = Stream(df, by, order, rows).add(_before=last(ts, exclusive=True))
        step = F.when(F.col(ts).isNotNull(), F.coalesce(unwrapped_step(F.col(ts) - F.col("_before"), bits), F.col(ts)))
        s = s.map(lambda d: d.withColumn("_step", step)).add(_total=total("_step"))
        return s.df.withColumn("unwrapped", F.when(F.col(ts).isNotNull(), F.col("_total"))).drop("_before", "_step", "_total")
    w = Window.partitionBy(*by).orderBy(*order)
    # Steps from the last reading that is there; the first reading counts itself.
    prev = F.last(ts, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    step = F.when(F.col(ts).isNotNull(), F.coalesce(unwrapped_step(F.col(ts) - prev, bits), F.col(ts)))
    upto = F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("unwrapped", F.when(F.col(ts).isNotNull(), upto))


def uniform(df: DataFrame, by: list[str], order: list, ts: str, mode: str = "uniform", low: float = 0.5, high: float = 1.5) -> DataFrame:
    """``rebuilt`` times on an even grid from the first, or with only odd steps replaced (``interp``).

    The period is the mean of the steps within a tenth of the median, the median if there are none.
    """
    s = steps(df, by, order, ts)
    mid = s.groupBy(*by).agg(F.percentile("step", F.lit(0.5)).alias("_mid"))
    s = s.join(mid, by)
    near = (F.col("step") > F.col("_mid") * 0.9) & (F.col("step") < F.col("_mid") * 1.1)
    period = s.groupBy(*by).agg(F.rint(F.coalesce(F.avg(F.when(near, F.col("step"))), F.first("_mid"))).cast("long").alias("period"), F.min_by(ts, F.struct(*order)).alias("_origin"))
    s = s.join(period, by)
    w = Window.partitionBy(*by).orderBy(*order)
    if mode == "uniform":
        made = F.col("_origin") + (F.row_number().over(w) - 1) * F.col("period")
    else:
        odd = (F.col("step") <= 0) | (F.col("step") > F.col("period") * high) | (F.col("step") < F.col("period") * low)
        made = F.col("_origin") + F.sum(F.coalesce(F.when(odd, F.col("period")).otherwise(F.col("step")), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return s.withColumn("rebuilt", made.cast("long")).drop("prev", "step", "_mid", "_origin")


def online_uniform(df: DataFrame, by: list[str], order: list, ts: str, nominal: int, lock: int = 60) -> DataFrame:
    """What a clock gives that runs at the nominal period until ``lock`` clean steps (half to one and a half of it) are
    seen, and at their mean from then on; readings of 0 or null give 0 and take no turn."""
    seen = df.withColumn("_ok", F.coalesce(F.col(ts) != 0, F.lit(False)))
    w = Window.partitionBy(*by).orderBy(*order)
    s = steps(seen.filter("_ok"), by, order, ts)
    clean = F.col("step").between(0.5 * nominal, 1.5 * nominal) & (F.col("step") > 0)
    s = s.withColumn("_clean", F.coalesce(clean, F.lit(False))).withColumn("_nth", F.sum(F.col("_clean").cast("int")).over(w)).withColumn("_k", F.row_number().over(w) - 1)
    first = s.filter(F.col("_clean") & (F.col("_nth") <= lock)).groupBy(*by).agg(F.avg("step").alias("_mean"), F.count("*").alias("_n"))
    origin = s.groupBy(*by).agg(F.min_by(ts, F.struct(*order)).alias("_origin"))
    s = s.join(origin, by).join(first, by, "left")
    period = F.when((F.col("_n") == lock) & (F.col("_nth") >= lock), F.rint("_mean")).otherwise(nominal)
    made = s.withColumn("even", (F.col("_origin") + F.col("_k") * period).cast("long")).drop("prev", "step", "_ok", "_clean", "_nth", "_k", "_mean", "_n", "_origin")
    return made.unionByName(seen.filter("not _ok").drop("_ok").withColumn("even", F.lit(0).cast("long")))


def rebuilt_from_host(df: DataFrame, by: list[str], order: list, host: str, quantum: int = 1000) -> DataFrame:
    """Device times from host times: usual steps become the mean of the clean ones, true gaps (over one and a half
    medians) stay; times are multiples of the quantum and increase strictly.

    Times are whole numbers and so is all that is added up, so that halves of a quantum go to the even multiple whatever
    the mean: sums of doubles would let the order of adding decide.
    """
    s = steps(df.withColumn("_host", F.col(host).cast("long")), by, order, "_host")
    mid = s.groupBy(*by).agg(F.percentile("step", F.lit(0.5)).alias("_mid"))
    s = s.join(mid, by)
    clean = F.col("step").between(F.col("_mid") * 0.5, F.col("_mid") * 1.5)
    mean = s.filter(clean).groupBy(*by).agg(F.sum("step").alias("_sum"), F.count("*").alias("_n"))
    # Without a clean step the median stands in, which is a whole number of halves.
    s = s.join(mean, by, "left").withColumns({"_sum": F.coalesce("_sum", F.rint(F.col("_mid") * 2).cast("long"), F.lit(0)), "_n": F.coalesce("_n", F.lit(2))})
    w = Window.partitionBy(*by).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    gap = F.col("step") > 1.5 * F.col("_mid")
    s = s.withColumns({"_origin": F.first("_host").over(upto), "_gaps": F.sum(F.when(gap, F.col("step")).otherwise(0)).over(upto), "_usual": F.count_if(~gap).over(upto), "_i": F.row_number().over(w)})
    # The time since the quantum in which the stream begins is _whole + _part / _n.
    part = F.col("_usual") * F.pmod("_sum", "_n")
    s = s.withColumn("_part", F.pmod(part, F.col("_n")))
    s = s.withColumn("_whole", F.pmod("_origin", F.lit(quantum)) + F.col("_gaps") + F.col("_usual") * _quotient(F.col("_sum"), F.col("_n")) + _quotient(part, F.col("_n")))
    s = s.withColumn("_k", _quotient(F.col("_whole"), F.lit(quantum)))
    over = 2 * (F.pmod("_whole", F.lit(quantum)) * F.col("_n") + F.col("_part")) - F.col("_n") * quantum
    up = (over > 0) | ((over == 0) & (F.col("_k") % 2 != 0))
    s = s.withColumn("_at", _quotient(F.col("_origin"), F.lit(quantum)) + F.col("_k") + up.cast("long"))
    # Strictly increasing: the running maximum of time less rank, and the rank again.
    s = s.withColumn("rebuilt", (F.max(F.col("_at") - F.col("_i")).over(upto) + F.col("_i")) * quantum)
    return s.drop("prev", "step", "_host", "_mid", "_sum", "_n", "_origin", "_gaps", "_usual", "_i", "_part", "_whole", "_k", "_at")


def _quotient(a: Column, b: Column) -> Column:
    """Of whole numbers, rounded down."""
    return F.call_function("div", a - F.pmod(a, b), b)


def shifted(df: DataFrame, stamps: str, shift: int, done: str) -> DataFrame:
    """Sample times moved by a constant, once: ``done`` marks rows that have been."""
    again = F.coalesce(F.col(done), F.lit(False))
    return df.withColumn(stamps, F.when(again, F.col(stamps)).otherwise(F.transform(stamps, lambda x: x + shift))).withColumn(done, F.lit(True))


def increasing(df: DataFrame, by: list[str], order: list, ts: str, rows: int | None = None) -> DataFrame:
    s = steps(df, by, order, ts, rows)
    return s.groupBy(*by).agg(F.count("*").alias("rows"), F.coalesce(F.bool_and(F.col("step") > 0), F.lit(True)).alias("increasing"))


def pair_offsets(df: DataFrame, row: list[str], stream: str, ts: str, epoch_gap: float, least: int = 1) -> DataFrame:
    """For each two streams that have readings in ``least`` rows or more: robust offsets; clocks of different epochs are info."""
    a = df.select(*row, F.col(stream).alias("a"), F.col(ts).alias("ta"))
    b = df.select(*row, F.col(stream).alias("b"), F.col(ts).alias("tb"))
    both = a.join(b, row).filter("a < b").withColumn("d", F.col("tb") - F.col("ta"))
    q = lambda p: F.percentile("d", F.lit(p))
    out = both.groupBy("a", "b").agg(F.count("*").alias("n"), q(0.5).alias("median"), (q(0.75) - q(0.25)).alias("iqr")).filter(F.col("n") >= least)
    return out.withColumn("same_epoch", F.abs("median") <= epoch_gap)
