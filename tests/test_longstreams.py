import random

import pytest
from pyspark.sql import functions as F

from kinetable.operators import align, assembly, clocks, longstreams, runs, stats
from kinetable.operators.longstreams import Stream, following, highest, last, previous, rank, total

ROWS = 40


@pytest.fixture(scope="module")
def streams(spark):
    """One hot stream, one of a null key, and small ones; times tie, values have nulls."""
    rng = random.Random(3)
    rows = []
    for key, n in (("hot", 700), (None, 150), ("a", 12), ("b", 1)):
        t = 0
        for _ in range(n):
            t += rng.choice((0, 1, 1, 2, 30))
            rows.append((key, t, len(rows), rng.choice((None, None, 1.0, 2.0, 3.5)), rng.choice("xxy"), (t * 37) % 256))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, t long, i long, v double, c string, w long").repartition(5)


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(None if r[c] is None else round(r[c], 9) if isinstance(r[c], float) else r[c] for c in names) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    "fn",
    [
        lambda d, by, n: clocks.gap_watch(d, by, ["t", "i"], "t", 1, 2, n),
        lambda d, by, n: clocks.regressions(d, by, ["i"], "w", 8, n),
        lambda d, by, n: clocks.jumps(d, by, ["t", "i"], "t", rows=n),
        lambda d, by, n: stats.segment_steps(d, by, ["t", "i"], "w", 7, n, n or stats.MOST),
        lambda d, by, n: stats.growth(d, by, ["t", "i"], "w", 6, n, n or stats.MOST),
        lambda d, by, n: stats.half_drift(d, by, ["t", "i"], "v", 20, n, n or stats.MOST),
        lambda d, by, n: stats.display_range(d, by, "v", 1.5, most=n or stats.MOST),
        lambda d, by, n: stats.scale_of(d, by, "w", "t", 50, most=n or stats.MOST),
        lambda d, by, n: clocks.increasing(d, by, ["t", "i"], "t", n),
        lambda d, by, n: clocks.unwrapped(d, by, ["t", "i"], "w", 8, n),
        lambda d, by, n: clocks.unwrapped(d.withColumn("w", F.when(F.col("v").isNotNull(), F.col("w"))), by, ["t", "i"], "w", 8, n),
        lambda d, by, n: runs.runs_of(d, by, ["t", "i"], "c", "i", 2, n),
        lambda d, by, n: runs.runs_of(d, by, ["t", "i"], "v", "i", 1, n),
        lambda d, by, n: runs.density(d, by, "t", 7, n),
        lambda d, by, n: runs.floods(d, by, "t", 7, 9, 5, n),
        lambda d, by, n: runs.interpolated(d.select(*by, "i", "v"), by, "i", "v", n),
        lambda d, by, n: runs.merged_ranges(d.select(*by, F.col("t").alias("a"), (F.col("t") + F.col("i") % 5).alias("z")), by, "a", "z", 1, n),
        lambda d, by, n: runs.merged_ranges(d.select(*by, F.col("t").alias("a"), (F.col("t") + F.col("i") % 3).alias("z")), by, "a", "z", 0, n),
    ],
)
def test_equals_one_window(streams, fn):
    streams = streams.filter("k is not null")  # joins by key of the plain forms drop null keys
    assert rows_of(fn(streams, ["k"], ROWS)) == rows_of(fn(streams, ["k"], None))


@pytest.mark.parametrize(("direction", "by"), [("backward", ["k"]), ("forward", []), ("nearest", ["k"])])
def test_asof_equals_one_window(streams, direction, by):
    left = streams.filter("c = 'y'").select(*by, "t", "i").unionByName(streams.limit(1).select(*by, F.lit(None).cast("long").alias("t"), F.lit(-1).cast("long").alias("i")))
    right = streams.filter("c = 'x'").select(*by, "t", F.col("i").alias("j"), "v")
    if by:
        left, right = left.filter("k is not null"), right.filter("k is not null")
    cut, whole = (align.asof(left, right, by, "t", direction, tolerance=20, tie="j", rows=n) for n in (ROWS, None))
    assert rows_of(cut) == rows_of(whole)


def test_offsets(spark):
    e = spark.createDataFrame([(i * 3, i % 4) for i in range(500)], "episode_index long, length long")
    assert rows_of(assembly.offsets(e, rows=30)) == rows_of(assembly.offsets(e, width=7))


def test_one_stream_is_many_ranges_of_about_so_many_rows(streams):
    s = Stream(streams, [], ["t", "i"], ROWS)
    sizes = [r["count"] for r in s._rows.groupBy("_range").count().collect()]
    assert s.split and len(sizes) > 15 and max(sizes) < 3 * ROWS
    plan = s.add(n=total(F.lit(1))).df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


def test_cuts_of_a_long_stream_do_not_grow_with_its_rows(spark, monkeypatch):
    """Each row is held against all cuts of its stream: so many more of both would be work by the square."""
    monkeypatch.setattr(longstreams, "RANGES", 20)
    found = {}
    for n in (1000, 4000):
        df = spark.range(n).select(F.lit("s").alias("k"), F.col("id").alias("t"), F.lit(1.0).alias("v"))
        s = Stream(df, ["k"], ["t"], 5)
        sizes = [r["count"] for r in s._rows.groupBy("_range").count().collect()]
        assert 10 < len(sizes) <= 21 and max(sizes) < 3 * n / 20
        found[n] = rows_of(s.add(n=total("v"), p=previous("t")).df) == rows_of(Stream(df, ["k"], ["t"], n).add(n=total("v"), p=previous("t")).df)
    assert all(found.values())


def test_measures(streams):
    order = ["t", "i"]
    asked = {"s": total("v"), "b": total("v", exclusive=True), "h": highest("v"), "l": last("v"), "e": last("v", exclusive=True), "f": following("v"), "p": previous("v"), "r": rank()}
    cut, whole = (Stream(streams, ["k"], order, n).add(**asked).df for n in (ROWS, 10_000))
    assert rows_of(cut) == rows_of(whole)
    rows = sorted((r for r in whole.collect() if r["k"] == "hot"), key=lambda r: (r["t"], r["i"]))
    seen = []
    for n, r in enumerate(rows):
        assert r["p"] == (rows[n - 1]["v"] if n else None) and r["r"] == n and r["b"] == (sum(seen) if seen else None)
        seen += [r["v"]] if r["v"] is not None else []
        assert r["s"] == (sum(seen) if seen else None) and r["h"] == max(seen, default=None) and r["l"] == (seen[-1] if seen else None)


def test_empty(streams):
    assert clocks.gap_watch(streams.limit(0), ["k"], ["t"], "t", 1, 2, ROWS).collect() == []
