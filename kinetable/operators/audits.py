"""Audits of whole recordings: streams against one another, against what the recorder says, and against the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.functions.values import norm
from kinetable.operators.runs import numbered

# Fixed thresholds: offsets from their baseline and their spread (ns), and shares.
OFFSET_WARN, OFFSET_ERROR, SPREAD_WARN, SPREAD_ERROR = 25_000_000, 100_000_000, 20_000_000, 60_000_000
LENGTH_SHARE, RATE_NEAR, COUNT_SHARE = 0.01, 0.005, 0.001


def meta_length(rows: DataFrame, meta: DataFrame, by: list[str], ts: str) -> DataFrame:
    """Rows and duration against what an episode's meta row says (length, duration); durations may differ by a hundredth."""
    own = rows.groupBy(*by).agg(F.count("*").alias("rows"), (F.max(ts) - F.min(ts)).alias("span"))
    both = own.join(meta, by, "full")
    far = F.abs(F.col("span") - F.col("duration")) > LENGTH_SHARE * F.col("duration")
    problem = F.when(F.col("length").isNull(), "no meta row").when(F.col("rows").isNull(), "no rows").when(F.col("rows") != F.col("length"), "length").when(far, "duration")
    return both.withColumn("problem", problem)


def presence_mismatch(df: DataFrame, by: list[str], stamps: str, values: str) -> DataFrame:
    """Rows with times but no values, and the other way round."""
    t, v = F.coalesce(F.size(stamps), F.lit(0)) > 0, F.coalesce(F.size(values), F.lit(0)) > 0
    return df.groupBy(*by).agg(F.count_if(t & ~v).alias("no_values"), F.count_if(v & ~t).alias("no_times"))


def cross_counts(streams: DataFrame, by: list[str]) -> DataFrame:
    """Streams (stream, clock, rate, samples, span) of like rate and clock against the fullest of them; what is short of
    it by more than two and a thousandth has another rate or another span."""
    # Rates within half a percent: the logarithm in steps of that size.
    band = F.floor(F.ln("rate") / F.log1p(F.lit(RATE_NEAR)))
    w = Window.partitionBy(*by, "clock", "_band")
    s = streams.withColumn("_band", band).withColumn("_most", F.max("samples").over(w)).withColumn("_longest", F.max("span").over(w))
    short = F.col("_most") - F.col("samples")
    off = short > F.greatest(F.lit(2.0), F.col("_most") * COUNT_SHARE)
    spans = (F.col("_longest") - F.col("span")) * F.col("rate")
    cause = F.when(off & (spans >= short / 2), "span").when(off, "rate")
    return s.withColumn("missing", short).withColumn("cause", cause).drop("_band", "_most", "_longest")


def lonely_gaps(rows: DataFrame, by: list[str], row: str, stream: str, n: str) -> DataFrame:
    """Rows in which one stream is empty although another isn't."""
    busy = F.max(n).over(Window.partitionBy(*by, row)) > 0
    return rows.withColumn("_b", busy).filter((F.col(n) == 0) & F.col("_b")).groupBy(*by, stream).agg(F.count("*").alias("rows"))


def self_reported(streams: DataFrame, episodes: DataFrame, by: list[str], stats: str) -> DataFrame:
    """Samples against the recorder's own sums, a JSON map of name to {received, dropped, offline_adjust}."""
    kind = "map<string,struct<received:bigint,dropped:bigint,offline_adjust:bigint>>"
    said = episodes.select(*by, F.explode(F.from_json(stats, kind)).alias("stream", "s"))
    both = streams.join(said, [*by, "stream"], "left")
    expected = F.col("s.received") + F.coalesce("s.offline_adjust", F.lit(0))
    return both.select(*by, "stream", "samples", expected.alias("said"), (F.col("samples") - expected).alias("difference"), F.coalesce("s.dropped", F.lit(0)).alias("dropped"))


def offsets(df: DataFrame, by: list[str], order: str, stamp: str, reference: str, baseline: Column | float = 0.0, parts: int = 20) -> DataFrame:
    """A stream's times against a reference in the same rows: median offset beyond the baseline, spread, largest step of
    the medians of equal parts, and drift in millionths."""
    d = (F.col(stamp) - F.col(reference)).cast("double")
    rows = df.filter(d.isNotNull()).withColumn("_d", d).withColumn("_part", F.ntile(parts).over(Window.partitionBy(*by).orderBy(order)))
    mid = rows.groupBy(*by, "_part").agg(F.percentile("_d", F.lit(0.5)).alias("_m"))
    step = mid.withColumn("_s", F.abs(F.col("_m") - F.lag("_m").over(Window.partitionBy(*by).orderBy("_part")))).groupBy(*by).agg(F.max("_s").alias("step"))
    q = lambda p: F.percentile("_d", F.lit(p))
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), q(0.5).alias("median"), (q(0.75) - q(0.25)).alias("iqr"), (F.regr_slope("_d", F.col(reference).cast("double")) * 1e6).alias("drift_ppm"))
    out = out.join(step, by).withColumn("beyond", F.abs(F.col("median") - (F.lit(baseline) if isinstance(baseline, float) else baseline)))
    severity = F.when((F.col("beyond") > OFFSET_ERROR) | (F.col("iqr") > SPREAD_ERROR), "error").when((F.col("beyond") > OFFSET_WARN) | (F.col("iqr") > SPREAD_WARN), "warn").otherwise("info")
    return out.withColumn("severity", severity)


def gap_events(df: DataFrame, by: list[str], order: str, wall: str, device: str, nominal: float, least: float, merge: int = 3) -> DataFrame:
    """Gaps on either of two clocks, those no more than ``merge`` rows apart as one: seen by both, by one, or by both to
    a different length; and the time lost on each."""
    w = Window.partitionBy(*by).orderBy(order)
    s = df.withColumn("_i", F.row_number().over(w))
    over = {n: F.greatest(F.col(c) - F.lag(c).over(w) - nominal, F.lit(0)) for n, c in (("wall", wall), ("device", device))}
    s = s.withColumns({f"lost_{n}": F.when(x >= least, x).otherwise(0) for n, x in over.items()}).filter("lost_wall > 0 or lost_device > 0")
    runs = numbered(s, by, ["_i"], F.col("_i") - F.lag("_i").over(Window.partitionBy(*by).orderBy("_i")) > merge)
    out = runs.groupBy(*by, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.sum("lost_wall").alias("lost_wall"), F.sum("lost_device").alias("lost_device"))
    alike = F.abs(F.col("lost_wall") - F.col("lost_device")) <= nominal
    kind = F.when(F.col("lost_device") == 0, "wall").when(F.col("lost_wall") == 0, "device").when(alike, "both").otherwise("mismatch")
    return out.withColumn("kind", kind).drop("run")


def sequence_audit(df: DataFrame, by: list[str], order: str, seq: str, ts: str, grid: float, slack: float) -> DataFrame:
    """Counters that go back, numbers that are lost, and times off the grid by more than the slack."""
    w = Window.partitionBy(*by).orderBy(order)
    d = F.col(seq) - F.lag(seq).over(w)
    off = F.abs(F.col(ts) - F.lag(ts).over(w) - d * grid) > slack
    s = df.withColumn("_d", d).withColumn("_off", off & (d > 0))
    return s.groupBy(*by).agg(F.count_if(F.col("_d") < 0).alias("back"), F.coalesce(F.sum(F.when(F.col("_d") > 1, F.col("_d") - 1)), F.lit(0)).alias("lost"), F.count_if("_off").alias("off_grid"))


def summary(findings: DataFrame, check: str, severity: str, episode: str, skip: Column | None = None) -> DataFrame:
    """Findings by check: episodes that have one, and errors, warnings and notes; bookkeeping ones are left out."""
    own = findings if skip is None else findings.filter(~skip)
    return own.groupBy(check).agg(F.countDistinct(episode).alias("episodes"), *[F.count_if(F.col(severity) == s).alias(s) for s in ("error", "warn", "info")])


def stream_totals(streams: DataFrame, by: list[str]) -> DataFrame:
    """Samples, those expected, deviation and coverage over episodes, and the offset weighted by samples."""
    out = streams.groupBy(*by).agg(F.sum("samples").alias("samples"), F.sum("expected").alias("expected"), F.avg("coverage").alias("coverage"), F.try_divide(F.sum(F.col("offset") * F.col("samples")), F.sum(F.when(F.col("offset").isNotNull(), F.col("samples")))).alias("offset"))
    return out.withColumn("deviation_pct", 100 * F.try_divide(F.col("samples") - F.col("expected"), F.col("expected")))


def column_health(df: DataFrame, by: list[str], values: str, quaternion: str | None = None) -> DataFrame:
    """Share of NaN, positions that ever change, and quaternions that aren't of length one."""
    cells = df.select(*by, F.posexplode(values).alias("i", "x")).groupBy(*by, "i").agg(F.count("*").alias("n"), F.count_if(F.isnan("x")).alias("nan"), F.stddev_pop(F.when(~F.isnan("x"), F.col("x"))).alias("s"))
    out = cells.groupBy(*by).agg(F.try_divide(F.sum("nan"), F.sum("n")).alias("nan_share"), F.count_if(F.col("s") > 1e-6).alias("active"))
    if quaternion is None:
        return out
    q = df.withColumn("_q", norm(quaternion)).groupBy(*by).agg(F.avg("_q").alias("quat_norm"), F.count_if(F.abs(F.col("_q") - 1) > 0.05).alias("bad_norm"))
    return out.join(q, by)


def lag_peaks(df: DataFrame, by: list[str], lag: str) -> DataFrame:
    """The largest delay and the number of readings; negative ones don't count."""
    return df.filter(F.col(lag) >= 0).groupBy(*by).agg(F.max(lag).alias("peak"), F.count("*").alias("readings"))


def completeness(hands: DataFrame, by: list[str], order: str, points: str, full: int = 21, flip: float = 0.1) -> DataFrame:
    """Of hands as arrays of points: share that is whole, median of valid points, jumps in depth of the first point."""
    valid = F.size(F.filter(points, lambda p: F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x))))
    z = F.get(F.get(points, F.lit(0)), F.lit(2))
    w = Window.partitionBy(*by).orderBy(order)
    s = hands.withColumn("_v", valid).withColumn("_z", z).withColumn("_dz", F.abs(F.col("_z") - F.lag("_z").over(w)))
    return s.groupBy(*by).agg(F.avg((F.col("_v") == full).cast("double")).alias("full"), F.percentile("_v", F.lit(0.5)).alias("points"), F.count_if(F.col("_dz") > flip).alias("flips"), F.avg((F.col("_z").isNotNull() & ~F.isnan("_z")).cast("double")).alias("wrist"))


def upload_history(events: DataFrame, key: str, at: str) -> DataFrame:
    """Uploads as new or repeated, and the latest of each episode."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(at))
    return events.withColumn("kind", F.when(nth == 1, "new_batch").otherwise("reupload")).withColumn("latest", F.col(at) == F.max(at).over(Window.partitionBy(key)))


def covering(frames: DataFrame, samples: DataFrame, by: list[str], ts: str) -> DataFrame:
    """Whether the samples of an episode begin before and end after its frames."""
    f = frames.groupBy(*by).agg(F.min(ts).alias("f0"), F.max(ts).alias("f1"))
    s = samples.groupBy(*by).agg(F.min(ts).alias("s0"), F.max(ts).alias("s1"))
    return f.join(s, by, "left").withColumn("covered", F.coalesce((F.col("s0") <= F.col("f0")) & (F.col("s1") >= F.col("f1")), F.lit(False)))
