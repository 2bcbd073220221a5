"""Streams with one planted defect each: it has to be found, and the clean stream has to stay silent."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.functions import values as V
from kinetable.operators import clocks, runs, stats

PERIOD = 33_333_333
BASE = 187_719_536_000


def stream(name, n=900):
    t = [BASE + i * PERIOD for i in range(n)]
    if name == "regression":
        t[300] = t[299] - 2 * PERIOD
    if name == "duplicate":
        t[200] = t[199]
    if name == "jump":
        t = t[:450] + [x + 20 * PERIOD for x in t[450:]]
    return [(name, i, x) for i, x in enumerate(t)]


@pytest.fixture(scope="module")
def streams(spark):
    data = [r for n in ("clean", "regression", "duplicate", "jump") for r in stream(n)]
    return spark.createDataFrame(data, "stream string, i long, ts long").cache()


def by_stream(df, column):
    return {r["stream"]: r[column] for r in df.collect()}


def test_regressions(streams):
    assert by_stream(clocks.regressions(streams, ["stream"], ["i"], "ts"), "regressions") == {"clean": 0, "regression": 1, "duplicate": 0, "jump": 0}


def test_duplicates(streams):
    out = clocks.duplicates(streams, ["stream"], ["i"], "ts")
    assert by_stream(out, "duplicates") == {"clean": 0, "regression": 0, "duplicate": 1, "jump": 0}
    assert by_stream(out, "severity")["duplicate"] == "error"


def test_jumps(streams):
    out = clocks.jumps(streams, ["stream"], ["i"], "ts")
    assert by_stream(out, "gaps") == {"clean": 0, "regression": 1, "duplicate": 1, "jump": 1}
    assert by_stream(out, "severity")["jump"] == "error" and by_stream(out, "severity")["clean"] == "info"


def test_gap_watch_and_increasing(streams):
    out = clocks.gap_watch(streams, ["stream"], ["i"], "ts", PERIOD, PERIOD)
    assert by_stream(out, "lost")["jump"] == 20 * PERIOD and by_stream(out, "lost")["clean"] == 0
    assert by_stream(clocks.increasing(streams, ["stream"], ["i"], "ts"), "increasing") == {"clean": True, "regression": False, "duplicate": False, "jump": True}


def test_bursty_cadence_is_no_gap(spark):
    t, at = [], 0
    for i in range(600):
        at += (20, 20, 60)[i % 3] * 1_000_000 + (200_000_000 if i == 300 else 0)
        t.append(("b", i, at))
    df = spark.createDataFrame(t, "stream string, i long, ts long")
    assert clocks.jumps(df, ["stream"], ["i"], "ts", bursty=True).first()["gaps"] == 1


def test_wraps_are_no_regressions(spark):
    raw = [(1 << 32) - 50 + 10 * i for i in range(20)]
    df = spark.createDataFrame([("s", i, x % (1 << 32)) for i, x in enumerate(raw)], "stream string, i long, ts long")
    out = clocks.regressions(df, ["stream"], ["i"], "ts", wrap_bits=32).first()
    assert (out["regressions"], out["wraps"]) == (0, 1)
    assert [r["unwrapped"] for r in clocks.unwrapped(df, ["stream"], ["i"], "ts").orderBy("i").collect()] == raw


def test_counts(spark):
    data = [("s", i, [] if i in (0, 4) else [1] * (9 if i == 6 else 2)) for i in range(10)]
    out = clocks.counts(spark.createDataFrame(data, "stream string, i long, v array<int>"), ["stream"], ["i"], "v").first()
    assert (out["empty_edge"], out["empty_inside"], out["bursts"], out["samples"]) == (1, 1, 1, 23)


def test_uniform_clocks(spark):
    raw = [1000, 2001, 2999, 4000, 9000]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(raw)], "stream string, i long, ts long")
    assert [r["rebuilt"] for r in clocks.uniform(df, ["stream"], ["i"], "ts").orderBy("i").collect()] == [1000, 2000, 3000, 4000, 5000]
    online = clocks.online_uniform(df, ["stream"], ["i"], "ts", 1000, lock=3)
    assert [r["even"] for r in online.orderBy("i").collect()] == [1000, 2000, 3000, 4000, 5000]
    zero = spark.createDataFrame([("s", 0, 50), ("s", 1, 0), ("s", 2, 150)], "stream string, i long, ts long")
    assert [r["even"] for r in clocks.online_uniform(zero, ["stream"], ["i"], "ts", 100).orderBy("i").collect()] == [50, 0, 150]


def test_rebuilt_from_host_keeps_gaps_and_increases(spark):
    raw = [0, 30_000, 66_000, 100_000, 500_000, 533_000]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(raw)], "stream string, i long, ts long")
    out = [r["rebuilt"] for r in clocks.rebuilt_from_host(df, ["stream"], ["i"], "ts").orderBy("i").collect()]
    assert all(b > a for a, b in zip(out, out[1:])) and out[4] - out[3] == 400_000 and all(x % 1000 == 0 for x in out)


def test_rebuilt_from_host_rounds_exact_halves_to_even(spark):
    """Steps with sevenths and the like as their mean: what is exactly half a quantum goes to the even one."""
    from fractions import Fraction

    rng, rows, want = random.Random(5), [], {}
    for k in range(60):
        steps = [rng.randrange(800_000_000, 1_200_000_000) for _ in range(rng.choice((7, 21, 49)))]
        times = [1_700_000_000_000_000 + rng.randrange(1000)]
        steps[-1] += (500 - times[0] - sum(steps)) % 1000  # the last time is half a quantum
        if k % 3 == 0:
            steps.insert(3, 9_000_000_000)
        for x in steps:
            times.append(times[-1] + x)
        ordered = sorted(steps)
        mid = Fraction(ordered[(len(steps) - 1) // 2] + ordered[len(steps) // 2], 2)
        clean = [x for x in steps if mid / 2 <= x <= mid * 3 / 2]
        beta, at, most = Fraction(sum(clean), len(clean)), Fraction(times[0] % 1000), None
        for i, t in enumerate(times):
            at += 0 if not i else steps[i - 1] if steps[i - 1] > mid * 3 / 2 else beta
            own = times[0] // 1000 + round(at / 1000) - i
            most = own if most is None else max(most, own)
            want[k, i] = (most + i) * 1000
            rows.append((k, i, t))
    df = spark.createDataFrame(rows, "stream long, i long, ts long")
    assert {(r["stream"], r["i"]): r["rebuilt"] for r in clocks.rebuilt_from_host(df, ["stream"], ["i"], "ts").collect()} == want


def test_shift_is_done_once(spark):
    df = spark.createDataFrame([([1, 2], None)], "t array<long>, done boolean")
    once = clocks.shifted(df, "t", 85, "done")
    assert once.first()["t"] == [86, 87] and clocks.shifted(once, "t", 85, "done").first()["t"] == [86, 87]


def test_stalls_and_holes(spark):
    df = spark.createDataFrame([("s", i, i * 10, i not in (2, 3, 7)) for i in range(8)], "stream string, i long, ts long, ok boolean")
    out = clocks.stalls(df, ["stream"], ["i"], "ts", "ok").first()
    assert (out["stalls"], out["stalled"], out["longest"]) == (2, 20, 20)
    holes = clocks.holes(spark.createDataFrame([(i,) for i in (0, 1, 1, 5, 205)], "n long"), "n", width=100)
    assert sorted(tuple(r) for r in holes.collect()) == [("missing", 2, 4), ("missing", 6, 204), ("repeated", 1, 1)]


def test_frozen_runs_ignore_zero(spark):
    data = [("s", i, [1, 2] if 10 <= i < 60 else [0, 0] if i < 5 else [i, i]) for i in range(100)]
    out = runs.frozen(spark.createDataFrame(data, "stream string, i long, v array<int>"), ["stream"], ["i"], "v", "i").collect()
    assert [(r["first"], r["length"], r["status"]) for r in out] == [(10, 50, "warn")]


def test_merged_ranges_and_coverage(spark):
    df = spark.createDataFrame([("s", 0.0, 1.0), ("s", 1.005, 2.0), ("s", 3.0, 4.0)], "k string, a double, z double")
    assert sorted((r["a"], r["z"]) for r in runs.merged_ranges(df, ["k"], "a", "z", 0.01).collect()) == [(0.0, 2.0), (3.0, 4.0)]
    seg = spark.createDataFrame([("s", 0, 9), ("s", 5, 14), ("s", 20, 29), ("s", 9, 3)], "k string, a long, z long")
    out = runs.coverage(seg, ["k"], "a", "z", F.lit(50)).first()
    assert (out["covered"], out["gaps"], out["overlaps"], out["invalid"], out["ratio"]) == (25, 1, 1, 1, 0.5)


def test_interpolation_at_the_ends_and_without_values(spark):
    data = [("a", 0, None), ("a", 1, 10.0), ("a", 2, None), ("a", 3, 30.0), ("a", 4, None), ("b", 0, None)]
    out = runs.interpolated(spark.createDataFrame(data, "k string, t int, v double"), ["k"], "t", "v").orderBy("k", "t")
    assert [r["filled"] for r in out.collect()] == [10.0, 10.0, 20.0, 30.0, 30.0, 0.0]


def test_statistics_skip_nan_and_merge(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([("a", 1.0), ("a", nan), ("a", 3.0), ("a", None), ("b", nan), ("c", inf), ("c", 1.0)], "k string, x double")
    out = {r["k"]: r for r in stats.scalar_stats(df, ["k"], "x").collect()}
    assert set(out) == {"a", "c"} and (out["a"]["mean"], out["a"]["std"], out["a"]["count"], out["a"]["q50"]) == (2.0, 1.0, 2, 2.0)
    assert out["c"]["max"] == inf and out["c"]["q50"] == 1.0
    whole = stats.from_blocks(stats.merged(stats.blocks(df.filter("k <> 'c'"), ["k"], "x"), [])).first()
    assert (whole["mean"], whole["std"], whole["count"]) == (2.0, 1.0, 2)
    empty = stats.from_blocks(stats.merged(stats.blocks(df.filter("k = 'b'"), ["k"], "x"), [])).first()
    assert (empty["mean"], empty["std"], empty["count"]) == (0.0, 1.0, 0)


def test_vector_statistics_leave_ragged_groups_out(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, float("nan")]), ("b", [1.0]), ("b", [1.0, 2.0])], "k string, v array<double>")
    out = {(r["k"], r["dim"]): (r["mean"], r["count"]) for r in stats.vector_stats(df, ["k"], "v").collect()}
    assert out == {("a", 0): (2.0, 1), ("a", 1): (2.0, 1)}


def test_depth_codes(spark):
    df = spark.createDataFrame([(0.0,), (100.0,), (5000.0,), (9000.0,), (50.0,), (1234.0,)], "mm double").withColumn("c", V.depth_code("mm")).withColumn("back", V.depth_mm("c"))
    got = [(r["c"], r["back"]) for r in df.collect()]
    assert got[0] == (0, 100) and got[1] == (0, 100) and got[2] == (4095, 5000) and got[3][0] == 4095 and got[4][0] == 0
    assert abs(got[5][1] - 1234) <= 1234 * 0.001


def test_names_and_arrays(spark):
    df = spark.createDataFrame([("x/episode_000123.parquet", 123, [1.0, 2.0, 3.0, 4.0])], "p string, i long, a array<double>")
    r = df.select(V.episode_index("p"), V.episode_name("i"), V.chunk_of(F.lit(1000)), V.chunk_of(F.lit(1000), one_based=True), V.grid("a", 2), V.padded("a", 5, F.lit(0.0)), V.fitted("a", 3), V.token(F.lit("A-b c!"))).first()
    assert tuple(r) == (123, "episode_000123", 1, 0, [[1.0, 2.0], [3.0, 4.0]], [1.0, 2.0, 3.0, 4.0, 0.0], [1.0, 2.0, 3.0], "a_b_c")


def test_names_of_a_million_episodes_stay_apart(spark):
    df = spark.createDataFrame([(7,), (999_999,), (1_000_000,), (12_345_678,)], "i long")
    got = df.select("i", V.episode_name("i").alias("name"), V.episode_index(F.concat(V.episode_name("i"), F.lit(".parquet"))).alias("back")).orderBy("i").collect()
    assert [r["name"] for r in got] == ["episode_000007", "episode_999999", "episode_1000000", "episode_12345678"]
    assert all(r["back"] == r["i"] for r in got)


@pytest.mark.parametrize("most", [5, 40])
def test_quantiles_of_large_groups_are_exact(spark, most):
    """Beyond a number of values they come from ever finer histograms: equal to the aggregate, whatever the distribution."""
    rng = random.Random(4)
    rows = [("even", rng.uniform(-5, 5)) for _ in range(400)] + [("skewed", math.exp(rng.gauss(0, 6))) for _ in range(300)]
    rows += [("hot", rng.choice((7.0, 7.0, 7.0, 8.0))) for _ in range(300)] + [("one", 3.0)] * 200 + [("few", float(i)) for i in range(3)] + [(None, float(i % 11)) for i in range(150)]
    rows += [("even", float("nan")), ("even", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    points = {"q01": 0.01, "q25": 0.25, "q50": 0.5, "q99": 0.99}
    got = {r["k"]: [r[c] for c in points] for r in stats.quantiles(df, ["k"], "x", points, most).collect()}
    want = {r["k"]: [r[c] for c in points] for r in stats.quantiles(df, ["k"], "x", points).collect()}
    assert set(got) == set(want) == {"even", "skewed", "hot", "one", "few", None}
    for k in want:
        own = np.array([x for n, x in rows if n == k and x is not None and x == x])
        assert np.allclose(want[k], np.quantile(own, list(points.values()))) and np.allclose(got[k], want[k], rtol=1e-12), k
    assert stats.quantiles(df.filter("k = 'skewed'"), [], "x", points, most).first()["q50"] == got["skewed"][2]
    whole = stats.scalar_stats(df, ["k"], "x", most=most).collect()
    assert {r["k"]: r["q50"] for r in whole} == {k: v[2] for k, v in got.items()}


def test_a_counter_goes_on_after_missing_readings(spark):
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate([100, None, 300, 400])] + [("b", i, t) for i, t in enumerate([None, (1 << 31) - 5, None, 5])], "k string, i int, t long")
    out = clocks.unwrapped(df, ["k"], ["i"], "t", 31).orderBy("k", "i").collect()
    assert [r["unwrapped"] for r in out] == [100, None, 300, 400, None, (1 << 31) - 5, None, (1 << 31) + 5]


def test_pairs_of_clocks_with_few_rows_in_common(spark):
    df = spark.createDataFrame([(i, s, i * 10 + d) for i in range(8) for s, d in (("a", 0), ("b", 3), ("c", 5)) if s != "c" or i < 3], "row int, s string, t long")
    out = clocks.pair_offsets(df, ["row"], "s", "t", 100, least=5).collect()
    assert [(r["a"], r["b"], r["n"], r["median"]) for r in out] == [("a", "b", 8, 3.0)]
