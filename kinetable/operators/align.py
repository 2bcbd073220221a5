"""Alignment of streams that were sampled on different clocks: as-of, interval and nearest joins.

An as-of join sorts both sides of a key together once.  A key that holds much of the data can be split into buckets of
time: each bucket then begins with the last row before it, which takes one small pass over the buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetable.operators.longstreams import Stream, following, last
from kinetable.sources.datasets import stored

_BACK, _AHEAD = "_back", "_ahead"


def _sides(left: DataFrame, right: DataFrame, by: list[str], on: str, tie: str) -> tuple[DataFrame, DataFrame]:
    lefts = left.select(*by, F.col(on).alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_tie"), F.struct(*left.columns).alias("_row"))
    held = F.struct(F.col(on).alias("_at"), *[c for c in right.columns if c not in by])
    rights = right.filter(F.col(on).isNotNull()).select(*by, F.col(on).alias("_t"), F.lit(0).alias("_side"), F.col(tie).cast("long").alias("_tie"), held.alias("_held"))
    return lefts, rights


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, direction: str = "backward", tolerance: float | None = None, tie: str | None = None, bucket: int | None = None, prefix: str = "r_", rows: int | None = None) -> DataFrame:
    """Each left row with the right row of its key that is the last up to it (``backward``), the first from it
    (``forward``) or the nearest, earlier of two equally near; right columns are prefixed, and null without a match.

    Of right rows at one time the one with the largest ``tie`` is last.  ``bucket`` splits keys by time; ``rows`` cuts
    keys that have more rows of both sides into ranges of about so many.
    """
    tie = tie or on
    lefts, rights = _sides(left, right, by, on, tie)
    both = lefts.unionByName(rights, allowMissingColumns=True)
    if rows:
        both = _ranged(both, by, direction, rows)
        return _picked(both, right, by, direction, tolerance, prefix)
    part = list(by)
    if bucket is not None:
        part = [*by, "_b"]
        slot = F.floor(F.col("_t") / bucket)
        both = both.withColumn("_b", slot).unionByName(_carried(both.withColumn("_b", slot), by, direction), allowMissingColumns=True)
    # At equal times right rows come first on the way forward, and are met last on the way back.
    ahead_of = Window.partitionBy(*part).orderBy("_t", "_side", "_tie")
    behind_of = Window.partitionBy(*part).orderBy(F.desc("_t"), "_side" if direction == "forward" else F.desc("_side"), F.desc("_tie"))
    if direction != "forward":
        both = both.withColumn(_BACK, F.last("_held", ignorenulls=True).over(ahead_of.rowsBetween(Window.unboundedPreceding, 0)))
    if direction != "backward":
        both = both.withColumn(_AHEAD, F.last("_held", ignorenulls=True).over(behind_of.rowsBetween(Window.unboundedPreceding, 0)))
    return _picked(both, right, by, direction, tolerance, prefix)


def _ranged(both: DataFrame, by: list[str], direction: str, rows: int) -> DataFrame:
    """Both sides with the right rows before and after, over ranges of each key."""
    back = [F.desc("_t"), F.col("_side") if direction == "forward" else F.desc("_side"), F.desc("_tie")]
    want = {_BACK: last("_held")} if direction != "forward" else {}
    want |= {_AHEAD: following("_held", *back)} if direction != "backward" else {}
    return Stream(both, by, ["_t", "_side", "_tie"], rows).add(**want).df


def _picked(both: DataFrame, right: DataFrame, by: list[str], direction: str, tolerance: float | None, prefix: str) -> DataFrame:
    """The left rows with the right row of the two that the direction asks for."""
    rows = both.filter("_side = 1")
    if direction == "backward":
        found = F.col(_BACK)
    elif direction == "forward":
        found = F.col(_AHEAD)
    else:
        back, ahead = F.col("_t") - F.col(f"{_BACK}._at"), F.col(f"{_AHEAD}._at") - F.col("_t")
        found = F.when(F.coalesce(back <= ahead, ahead.isNull()), F.col(_BACK)).otherwise(F.col(_AHEAD))
    rows = rows.withColumn("_found", F.when(F.col("_t").isNotNull(), found))  # a row without a time has no neighbours
    if tolerance is not None:
        rows = rows.withColumn("_found", F.when(F.abs(F.col("_found._at") - F.col("_t")) <= tolerance, F.col("_found")))
    return rows.select("_row.*", *[F.col(f"_found.{c}").alias(prefix + c) for c in right.columns if c not in by])


def _carried(both: DataFrame, by: list[str], direction: str) -> DataFrame:
    """For each bucket the right row before it and the right row after it, as rows of the bucket."""
    right = both.filter("_side = 0")
    edge = right.groupBy(*by, "_b").agg(F.max(F.struct("_t", "_tie", "_held")).alias("_last"), F.min(F.struct("_t", "_tie", "_held")).alias("_first"))
    edge = edge.unionByName(both.select(*by, "_b").distinct(), allowMissingColumns=True).groupBy(*by, "_b").agg(F.max("_last").alias("_last"), F.max("_first").alias("_first"))
    w = Window.partitionBy(*by).orderBy("_b")
    edge = edge.withColumn("_before", F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    edge = edge.withColumn("_after", F.first("_first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    ends = [c for c, use in (("_before", direction != "forward"), ("_after", direction != "backward")) if use]
    rows = edge.select(*by, "_b", F.explode(F.array(*ends)).alias("_e")).filter("_e is not null")
    return rows.select(*by, "_b", F.col("_e._t").alias("_t"), F.lit(0).alias("_side"), F.col("_e._tie").alias("_tie"), F.col("_e._held").alias("_held"))


def nearest_valid(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str, **options) -> DataFrame:
    """The nearest right row whose ``value`` is neither null nor NaN; readings at time 0 stand for none."""
    v = F.col(value)
    held = right.filter((F.col(on) > 0) & v.isNotNull() & (~F.isnan(v) if dict(right.dtypes)[value] in ("double", "float") else F.lit(True)))
    return asof(left, held, by, on, "nearest", **options)


def binned(samples: DataFrame, frames: DataFrame, by: list[str], on: str, period: float, frame: str) -> DataFrame:
    """Each sample with its frame: the last that began at or before it.  Samples before the first frame, or a period
    or more after theirs began, have a null frame, so that they can be counted."""
    found = asof(samples, frames.select(*by, on, frame), by, on, "backward", prefix="f_")
    return found.withColumn(frame, F.when(F.col(on) < F.col(f"f_{on}") + period, F.col(f"f_{frame}"))).drop(f"f_{frame}", f"f_{on}")


def first_from(samples: DataFrame, frames: DataFrame, by: list[str], on: str) -> DataFrame:
    """Each sample with the first frame at or after it; frames at time 0 take none, samples after the last have none."""
    return asof(samples, frames.filter(F.col(on) != 0), by, on, "forward", prefix="f_")


def bracketed(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], max_gap: float) -> DataFrame:
    """Values interpolated between the right rows before and after, if those are no more than ``max_gap`` apart."""
    held = right.select(*by, on, *values)
    out = asof(left, held, by, on, "backward", prefix="b_")
    out = asof(out, held, by, on, "forward", prefix="a_")
    gap = F.col(f"a_{on}") - F.col(f"b_{on}")
    share = F.when(gap == 0, 0.0).otherwise((F.col(on) - F.col(f"b_{on}")) / gap)
    fits = F.coalesce(gap <= max_gap, F.lit(False))
    made = [F.when(fits, F.col(f"b_{v}") + share * (F.col(f"a_{v}") - F.col(f"b_{v}"))).alias(v) for v in values]
    return out.select(*left.columns, *made)


def _told_apart(df: DataFrame) -> DataFrame:
    """Rows with a number, so that repeated ones stay apart when they are gathered again."""
    return df.withColumn("_id", F.monotonically_increasing_id())


def in_intervals(points: DataFrame, intervals: DataFrame, by: list[str], on: str, start: str, end: str, width: int, how: str = "inner") -> DataFrame:
    """Points with all intervals (both ends included) of their key that hold them, met in buckets of ``width``."""
    p = points.withColumn("_b", F.floor(F.col(on) / width))
    i = intervals.filter(F.col(end) >= F.col(start)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    p, i = p.alias("p"), i.alias("i")
    meet = [F.col(f"p.{c}") == F.col(f"i.{c}") for c in (*by, "_b")] + [F.col(f"p.{on}").between(F.col(f"i.{start}"), F.col(f"i.{end}"))]
    rest = [F.col(f"i.{c}") for c in intervals.columns if c not in by]
    return p.join(i, meet, how).select(*[F.col(f"p.{c}") for c in points.columns], *rest)


def first_interval(points: DataFrame, intervals: DataFrame, by: list[str], on: str, start: str, end: str, order: str, width: int) -> DataFrame:
    """Points with, of the intervals that hold them, the first by ``order``; without one its columns are null.

    Repeated points stay as many as they are; points without a time are in no interval.
    """
    rest = [c for c in intervals.columns if c not in by]
    met = in_intervals(_told_apart(points), intervals, by, on, start, end, width, "left")
    best = met.groupBy("_id").agg(F.first(F.struct(*points.columns)).alias("_p"), F.min_by(F.struct(*rest), F.col(order)).alias("_i"))
    return best.select("_p.*", *[F.col(f"_i.{c}").alias(c) for c in rest])


def best_overlap(segments: DataFrame, proposals: DataFrame, by: list[str], key: str, start: str, end: str, order: str, width: int) -> DataFrame:
    """Segments with the proposal of the largest Dice overlap 2 o / (a + b + 1e-6), the first of equals; null if none overlaps.

    Segments that end before they begin, or have no times, overlap with nothing.
    """
    s = _told_apart(segments).withColumn("_b", F.explode_outer(F.when(F.col(end) >= F.col(start), F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width)))))
    p = proposals.filter(F.col(end) >= F.col(start)).select(*by, F.col(order).alias("p_order"), F.col(start).alias("p_start"), F.col(end).alias("p_end"))
    p = p.withColumn("_b", F.explode(F.sequence(F.floor(F.col("p_start") / width), F.floor(F.col("p_end") / width))))
    over = F.least(F.col(end), F.col("p_end")) - F.greatest(F.col(start), F.col("p_start")) + 1
    length = F.col(end) - F.col(start) + 1 + F.col("p_end") - F.col("p_start") + 1
    met = s.join(p, [*by, "_b"], "left").withColumn("dice", F.when(over > 0, 2 * over / (length + 1e-6)))
    best = met.groupBy("_id").agg(F.first(F.struct(*segments.columns)).alias("_s"), F.max(F.struct("dice", (-F.col("p_order")).alias("o"))).alias("_m"))
    return best.select("_s.*", F.when(F.col("_m.dice").isNotNull(), -F.col("_m.o")).alias("proposal"), F.col("_m.dice").alias("dice"))


def hits(targets: DataFrame, others: DataFrame, by: list[str], on: str, low: float, high: float, key: str) -> DataFrame:
    """Targets with the number of others that lie ``low`` to ``high`` after them, and the offset nearest to 0.

    Repeated targets stay as many as they are; those without a time have no hits.
    """
    span = max(1, int(max(abs(low), abs(high))))
    o = others.select(*by, F.col(on).alias("_o")).withColumn("_b", F.floor(F.col("_o") / span))
    t = _told_apart(targets).withColumn("_b", F.explode_outer(F.sequence(F.floor((F.col(on) + low) / span), F.floor((F.col(on) + high) / span))))
    met = t.join(o, [*by, "_b"], "left").withColumn("_d", F.when((F.col("_o") - F.col(on)).between(low, high), F.col("_o") - F.col(on)))
    found = met.groupBy("_id").agg(F.first(F.struct(*targets.columns)).alias("_t"), F.count("_d").alias("hits"), F.min_by("_d", F.when(F.col("_d").isNotNull(), F.struct(F.abs("_d"), "_d"))).alias("nearest"))
    return found.select("_t.*", "hits", "nearest")


def keep_first(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """One row of each key, the first in this order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def with_results(frames: DataFrame, results: DataFrame, by: list[str], order: list, names: dict[str, str]) -> DataFrame:
    """Frames with result columns under new names, which replace those there are; the first of repeated results counts."""
    held = keep_first(results, by, order).select(*by, *[F.col(a).alias(b) for a, b in names.items()])
    return frames.drop(*names.values()).join(held, by, "left")


def suffixed(frames: DataFrame, labels: DataFrame, by: list[str], suffix: str = "_kpts") -> DataFrame:
    """Left join; label columns whose name the frames have take a suffix."""
    clash = {c: c + suffix for c in labels.columns if c in frames.columns and c not in by}
    return frames.join(labels.withColumnsRenamed(clash), by, "left")


def upserted(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """All rows of both; where both have a value the new one counts."""
    both = [c for c in old.columns if c in new.columns and c not in by]
    o, n = old.withColumnsRenamed({c: f"_o_{c}" for c in both}), new.withColumnsRenamed({c: f"_n_{c}" for c in both})
    rows = o.join(n, by, "full")
    return rows.withColumns({c: F.coalesce(f"_n_{c}", f"_o_{c}") for c in both}).drop(*[f"_o_{c}" for c in both], *[f"_n_{c}" for c in both])


def best_by_confidence(rows: DataFrame, by: list[str], confidence: str, order: str) -> DataFrame:
    """Per key the row of the highest confidence, the latest of equals; NaN neither replaces nor is replaced.

    Rows are met in ``order``: a NaN that comes first stays.
    """
    rest = [c for c in rows.columns if c not in by]
    c = F.col(confidence)
    held = rows.groupBy(*by).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"), F.max_by(F.struct(*rest), F.when(~F.isnan(c), F.struct(c, F.col(order)))).alias("_best"))
    keep = F.when(F.isnan(F.col(f"_first.{confidence}")) | F.col("_best").isNull(), F.col("_first")).otherwise(F.col("_best"))
    return held.withColumn("_row", keep).select(*by, *[F.col(f"_row.{x}").alias(x) for x in rest])


def longest_prefix(names: DataFrame, keys: DataFrame, name: str, key: str, lengths: list[int]) -> DataFrame:
    """Names with the longest key that they start with, met by equality on each of the keys' lengths; repeated names stay."""
    n = _told_apart(names).withColumn("_k", F.explode(F.array(*[F.struct(F.lit(k).alias("n"), F.substring(name, 1, k).alias("p")) for k in lengths])))
    k = keys.select(F.col(key).alias("_key")).distinct().withColumn("_len", F.length("_key"))
    met = n.join(k, (F.col("_k.p") == F.col("_key")) & (F.col("_k.n") == F.col("_len")), "left")
    best = met.groupBy("_id").agg(F.first(F.struct(*names.columns)).alias("_row"), F.max_by("_key", "_len").alias("match"))
    return best.select("_row.*", "match")


def owner_of(names: DataFrame, owners: DataFrame, name: str, key: str, owner: str, lengths: list[int]) -> DataFrame:
    """Names with the owner of their longest key, compared in small letters; ``ambiguous`` if several own it, and then no owner."""
    one = owners.groupBy(F.lower(key).alias("_k")).agg(F.min(owner).alias("_o"), F.countDistinct(owner).alias("_n"))
    best = longest_prefix(names.withColumn("_l", F.lower(name)), one, "_l", "_k", lengths).drop("_l")
    out = best.join(one.withColumnRenamed("_k", "match"), "match", "left")
    return out.select(*names.columns, "match", F.when(F.col("_n") == 1, F.col("_o")).alias(owner), F.coalesce(F.col("_n") > 1, F.lit(False)).alias("ambiguous"))


def repaired(stats: DataFrame, episodes: DataFrame, index: str, length: str) -> DataFrame:
    """Episodes with their stats row: the same index and length, else the only one of that length, else none."""
    exact = episodes.join(stats, [index, length], "left_semi").select(index, length).withColumn("source", F.lit("exact"))
    rest = episodes.join(exact, [index, length], "left_anti")
    single = stats.groupBy(length).agg(F.count("*").alias("_n"), F.min(index).alias("stats_index")).filter("_n = 1")
    other = rest.join(single, length, "left").select(index, length, F.when(F.col("stats_index").isNotNull(), "length").otherwise("none").alias("source"), "stats_index")
    return exact.withColumn("stats_index", F.col(index)).unionByName(other)


def token_overlap(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Names with the names that share most of their tokens, all of equal ones; names of the same tokens are met once.

    Tokens are in one order over both sides, the rarest first.  In turn n a name meets those that hold its n-th token, and
    only where more shared tokens can follow, by the places of that token in both, than its best partner shares.  Names
    that share none of the first n tokens share no more than the rest, so a name with a better partner is done.  A token
    that very many names have is the last of each, and is met only by names that share nothing better: such pairs are
    themselves the result.  There are as many turns as a name has tokens.
    """
    split = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda x: x != "")))
    a = left.select(F.col(left_key).alias("name"), split(F.col(left_key)).alias("_a")).filter(F.size("_a") > 0)
    b = right.select(F.col(right_key).alias("match"), split(F.col(right_key)).alias("_b")).filter(F.size("_b") > 0)
    sets = stored(a.select(F.col("_a").alias("_s"), F.lit(True).alias("_left")).union(b.select("_b", F.lit(False))).distinct(), "sets")
    tokens = sets.withColumn("t", F.explode("_s"))
    often = tokens.groupBy("t").agg(F.count("*").alias("_n"))
    rare = tokens.join(often, "t").groupBy("_s", "_left").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "t"))), lambda x: x["t"]).alias("_t"))
    rare = stored(rare, "tokens")
    open_ = rare.filter("_left").select(F.col("_s").alias("_a"), F.col("_t").alias("_ta"), F.lit(0).alias("best"))
    held = rare.filter("not _left").select(F.col("_s").alias("_b"), F.posexplode("_t").alias("_k", "t"))
    held = stored(held.withColumn("_after", F.size("_b") - F.col("_k") - 1), "postings")
    found, best, turn = None, open_.select("_a", "best").limit(0), 0
    while not open_.isEmpty():
        met = open_.withColumn("t", F.get("_ta", F.lit(turn))).join(held, "t").filter(F.col("_after") + 1 >= F.col("best"))
        fresh = ~F.arrays_overlap(F.slice("_ta", 1, turn), "_b") if turn else F.lit(True)  # else they have met before
        met = met.filter(fresh).select("_a", "_b", "best", F.size(F.array_intersect("_a", "_b")).alias("shared")).filter("shared >= best")
        met = stored(met.drop("best"), "met")
        found = met if found is None else found.union(met)
        better = met.groupBy("_a").agg(F.max("shared").alias("_new"))
        turn += 1
        open_ = stored(open_.join(better, "_a", "left").select("_a", "_ta", F.greatest("best", F.coalesce("_new", F.lit(0))).alias("best")), "open")
        done = F.col("best") > F.size("_ta") - turn
        best = best.union(open_.filter(done | (F.size("_ta") <= turn)).select("_a", "best"))
        open_ = open_.filter(~done & (F.size("_ta") > turn))
    if found is None:
        return a.select("name", F.lit("").alias("match"), F.lit(0).cast("long").alias("shared")).limit(0)
    pairs = found.join(best, "_a").filter("shared = best").select("_a", "_b", F.col("shared").cast("long").alias("shared"))
    return a.distinct().join(pairs, "_a").join(b.distinct(), "_b").select("name", "match", "shared")
