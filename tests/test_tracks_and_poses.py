import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.functions import rotations as R
from kinetable.operators import poses, tracks


def test_rotation_vectors(spark):
    def q(axis, angle):
        return [*(math.sin(angle / 2) * a for a in axis), math.cos(angle / 2)]

    for angle in (0.0, 1e-9, 0.3, math.pi / 2, math.pi - 1e-7, math.pi):
        df = spark.createDataFrame([(q((0.0, 0.6, 0.8), angle),)], "q array<double>")
        v = df.select(R.rotation_vector(R.unit("q"))).first()[0]
        assert np.allclose(v, [0, 0.6 * angle, 0.8 * angle], atol=1e-9)
    zero = spark.createDataFrame([([0.0] * 4, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 0.0])], "q array<double>, p array<double>")
    assert zero.select(R.unit("q")).first()[0] is None and zero.select(R.is_valid("p")).first()[0] is False
    m = spark.createDataFrame([(q((1.0, 0.0, 0.0), math.pi / 2),)], "q array<double>").select(R.matrix("q")).first()[0]
    assert np.allclose(m, [1, 0, 0, 0, 0, -1, 0, 1, 0])


def test_actions_of_known_motion(spark):
    turned = [0.0, 0.0, math.sin(math.pi / 4), math.cos(math.pi / 4)]
    data = [("e", i, [0.01 * i, 0.0, 0.0, *turned], g) for i, g in enumerate((0, 50, 500))]
    out = poses.actions(spark.createDataFrame(data, "e string, i int, pose array<double>, g int"), ["e"], "i", "pose", "g").orderBy("i").collect()
    # A step along x is one along -y for a frame that is turned by 90 degrees about z.
    assert np.allclose(out[0]["action"], [0, -0.01, 0, 0, 0, 0, 0.5], atol=1e-12)
    assert np.allclose(out[1]["action"], [0, -0.01, 0, 0, 0, 0, 1.0], atol=1e-12)
    assert np.allclose(out[2]["action"], [0, -0.01, 0, 0, 0, 0, 1.0], atol=1e-12)
    assert np.allclose(out[2]["state"], [0.02, 0, 0, 1.0])


def test_yaw_rate(spark):
    data = [("e", i, [0.0, 0.0, 0.0, 0.0, 0.0, math.sin(0.05 * i), math.cos(0.05 * i)]) for i in range(3)]
    out = poses.actions(spark.createDataFrame(data, "e string, i int, pose array<double>"), ["e"], "i", "pose").orderBy("i").collect()
    assert all(np.allclose(r["action"][:6], [0, 0, 0, 0, 0, 0.1]) for r in out)


def test_frame_poses_fit_the_clock_and_fill(spark):
    rows = []
    for i in range(10):
        own = [] if 4 <= i <= 7 else [1000 + i / 30.0, float(i), 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]
        rows.append(("e", i, i / 30.0, own))
    df = spark.createDataFrame(rows, "e string, i int, ts double, tr array<double>")
    out = poses.frame_poses(df, ["e"], "i", "ts", "tr").orderBy("i").collect()
    # Frames next to a sample take it (one and a half periods); the two between are on the line.
    assert np.allclose([r["pose"][0] for r in out], [0, 1, 2, 3, 3, 3 + 5 / 3, 3 + 10 / 3, 8, 8, 9], atol=1e-6)
    assert [r["i"] for r in out if r["interpolated"]] == [5, 6]


def test_trajectory_errors_after_a_rigid_motion(spark):
    t = np.linspace(0, 5, 40)
    a = np.stack([np.cos(t), np.sin(t), 0.1 * t], 1)
    b = a @ np.array([[0.0, 1, 0], [-1, 0, 0], [0, 0, 1]]) + [1, 2, 3]
    df = spark.createDataFrame([("e", float(x), p.tolist(), q.tolist()) for x, p, q in zip(t, a, b)], "e string, t double, p array<double>, q array<double>")
    r = poses.trajectory_errors(df, ["e"], "t", "p", "q").first()
    assert r["ate_max"] < 1e-9 and r["n"] == 40 and abs(r["length"] - r["true_length"]) < 1e-9


def test_triangulation(spark):
    p1 = np.array([[500.0, 0, 320, 0], [0, 500, 240, 0], [0, 0, 1, 0]])
    p2 = p1.copy()
    p2[0, 3] = -50.0
    x = np.array([0.1, -0.05, 0.8, 1])
    uv = [((p @ x)[:2] / (p @ x)[2]).tolist() for p in (p1, p2)]
    out = poses.triangulated(spark.createDataFrame([(*uv,), (uv[0], [0.0, 0.0])], "a array<double>, b array<double>"), "a", "b", p1, p2).collect()
    assert np.allclose(out[0]["xyz"], x[:3]) and out[1]["xyz"] is None


def test_one_euro_constant_and_start(spark):
    df = spark.createDataFrame([("s", i / 30, 5.0) for i in range(20)] + [("n", 0.0, None)], "k string, t double, x double")
    assert {r["smooth"] for r in tracks.one_euro(df, ["k"], "t", "x").collect()} == {5.0, None}


def test_alpha_beta_predicts_and_gives_up(spark):
    data = [("s", i, float(i) if i < 5 else None) for i in range(25)]
    out = tracks.alpha_beta(spark.createDataFrame(data, "k string, i long, x double"), ["k"], "i", "x").orderBy("i").collect()
    assert [r["state"] for r in out] == ["real"] * 5 + ["propagated"] * 15 + ["absent"] * 5
    assert out[0]["tracked"] == 0.0 and out[1]["tracked"] == 0.5  # half way from the prediction to the value


def test_gap_fill_is_exact_for_cubics_and_leaves_long_gaps(spark):
    f = lambda i: 0.5 * i**3 - i + 2
    data = [("s", i, None if 10 <= i < 14 or 30 <= i < 50 else float(f(i))) for i in range(60)]
    out = tracks.fill_gaps(spark.createDataFrame(data, "k string, i long, x double"), ["k"], "i", "x").orderBy("i").collect()
    assert all(abs(out[i]["filled"] - f(i)) < 1e-3 and out[i]["propagated"] for i in range(10, 14))
    assert all(out[i]["filled"] is None or math.isnan(out[i]["filled"]) for i in range(30, 50))


def test_savgol_keeps_parabolas():
    y = np.array([0.3 * i * i - 2 * i + 1 for i in range(30)])
    assert np.allclose(tracks.savgol(y, 7), y)
    assert np.allclose(tracks.savgol(y[:2], 7), y[:2])


def in_order(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy(columns[0]).collect()]


def events_of(spark, events, **more):
    rows = [("s", f, k, *more.values()) for f, k in events]
    return spark.createDataFrame(rows, "k string, f long, kind string" + "".join(f", {c} long" for c in more))


def test_events_merge_and_flutter(spark):
    e = events_of(spark, [(0, "grasp"), (10, "grasp"), (100, "grasp"), (110, "open")])
    assert in_order(tracks.merged_events(e, ["k"], "f", "kind", 18), "f", "kind") == [(0, "grasp"), (110, "open")]
    e = events_of(spark, [(0, "grasp"), (20, "open"), (200, "grasp")])
    assert in_order(tracks.without_flutter(e, ["k"], "f", "kind", 60), "f", "kind") == [(200, "grasp")]


@pytest.mark.parametrize("seed", range(3))
def test_events_against_a_walk(spark, seed):
    """Both rules of debouncing event by event, over several keys and batches."""
    rng = random.Random(seed)
    events = {k: [(f, rng.choice(("grasp", "open"))) for f in sorted(rng.sample(range(900), 60))] for k in "abc"}
    rows = [(k, f, x) for k, own in events.items() for f, x in own]
    df = spark.createDataFrame(rows, "k string, f long, kind string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        merged = sorted(map(tuple, tracks.merged_events(df, ["k"], "f", "kind", 18).collect()))
        kept = sorted(map(tuple, tracks.without_flutter(df, ["k"], "f", "kind", 30).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want_merged, want_kept = [], []
    for k, own in events.items():
        anchors = []
        for e in own:
            if anchors and e[0] - anchors[-1][0] <= 18:
                if e[1] != anchors[-1][1]:
                    anchors[-1] = e
            else:
                anchors.append(e)
        want_merged += [(k, *e) for e in anchors]
        left = list(own)
        while left:
            e = left.pop(0)
            if left and left[0][1] != e[1] and left[0][0] - e[0] < 30:
                left.pop(0)
            else:
                want_kept.append((k, *e))
    assert merged == sorted(want_merged) and kept == sorted(want_kept)


def test_segments_cover_all_frames(spark):
    e = events_of(spark, [(100, "grasp"), (110, "open"), (300, "grasp")], total=600)
    s = in_order(tracks.event_segments(e, ["k"], "f", "kind", "total"), "start", "end", "label")
    assert s == [(0, 299, "phase"), (300, 599, "hold")]  # the short range, and what follows it, go to the one before
    e = events_of(spark, [(60 * i, "grasp") for i in range(1, 9)], total=600)
    s = in_order(tracks.event_segments(e, ["k"], "f", "kind", "total", most=3), "start", "end")
    assert len(s) == 3 and s[0][0] == 0 and s[-1][1] == 599 and all(a[1] + 1 == b[0] for a, b in zip(s, s[1:]))
    e = events_of(spark, [(0, "grasp"), (200, "open"), (201, "grasp")], total=700 * 30)
    assert in_order(tracks.event_segments(e, ["k"], "f", "kind", "total"), "start", "end", "label") == [(0, 20_999, "hold")]
    p = tracks.partitioned([(0.5, 2.0, "a"), (1.5, 4.0, "b"), (5.0, 4.0, "x")], 300, 30.0)
    assert [(r["start"], r["end"]) for r in p] == [(0, 44), (45, 299)]


def test_spans_are_joined_in_order_of_length():
    rng = random.Random(5)
    for _ in range(100):
        cuts = sorted(rng.sample(range(1, 500), rng.randrange(2, 12)))
        spans = list(zip([0, *cuts], [c - 1 for c in [*cuts, 500]]))
        most = rng.randrange(1, 6)
        want = [(a, z) for a, z in spans]
        while len(want) > most:
            i = min(range(len(want) - 1), key=lambda j: (want[j + 1][1] - want[j][0], j))
            want[i : i + 2] = [(want[i][0], want[i + 1][1])]
        assert [(spans[i][0], spans[j][1]) for i, j in tracks.capped(spans, most)] == want


@pytest.mark.parametrize("per_batch", [3, 1000])
def test_filters_carry_their_state_over_batches(spark, per_batch):
    rng = random.Random(9)
    rows = [(k, i, i / 30 + (2.0 if i > 40 else 0.0), None if rng.random() < 0.3 or 60 <= i < 80 else rng.uniform(0, 5), rng.choice(("", "l", "l", "r"))) for k in ("a", None) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, i long, t double, x double, l string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(per_batch))
    try:
        one = {(r["k"], round(r["t"], 6)): r["smooth"] for r in tracks.one_euro(df, ["k"], "t", "x", max_gap=1.0, jump=3.0, label="l").collect()}
        two = {(r["k"], r["i"]): (r["tracked"], r["state"]) for r in tracks.alpha_beta(df, ["k"], "i", "x", label="l").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for key in ("a", None):
        level = last = said = None
        speed, x0, v0, k0, name = 0.0, None, 0.0, None, ""
        for k, i, t, x, label in rows:
            if k != key:
                continue
            if x is not None:
                if level is None or t - last[0] > 1.0 or abs(x - last[1]) > 3.0 or label != said:
                    level, speed = x, 0.0
                else:
                    dt = t - last[0]
                    weight = lambda c: dt / (dt + 1 / (2 * math.pi * c))  # noqa: B023, E731
                    speed = speed + weight(1.0) * ((x - level) / dt - speed)
                    level = level + weight(1.0 + 0.007 * abs(speed)) * (x - level)
                last, said = (t, x), label
                assert abs(one[k, round(t, 6)] - level) < 1e-9
                if x0 is None or i - k0 > 15 or (name and label and label != name):
                    x0, v0 = x, 0.0
                else:
                    new = 0.5 * x + 0.5 * (x0 + v0 * (i - k0))
                    v0 = 0.1 * (new - x0) / (i - k0) + 0.9 * v0
                    x0 = new
                k0, name = i, label or name
                assert two[k, i][1] == "real" and abs(two[k, i][0] - x0) < 1e-9
            else:
                assert one[k, round(t, 6)] is None
                near = x0 is not None and i - k0 <= 15
                assert two[k, i][1] == ("propagated" if near else "absent") and (abs(two[k, i][0] - x0 - v0 * (i - k0)) < 1e-9 if near else two[k, i][0] is None)


def test_smoothing_equals_the_array_form(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 8, 20, 21, 22, 60):
        y = rng.normal(size=n).cumsum()
        a, b = tracks.savgol(y, 7), tracks.savgol(y, 21)
        w = np.clip(np.abs(np.gradient(a)) * 30 / 20.0, 0, 1) if n > 1 else np.zeros(1)
        s = w * a + (1 - w) * b
        want = np.where(np.abs(s - y) > 0.3, a, s)
        df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(y)], "k string, i long, x double")
        got = [r["smooth"] for r in tracks.smoothed(df, ["k"], "i", "x", still=20.0, keep_jump=0.3).orderBy("i").collect()]
        assert np.allclose(got, want, atol=1e-9), n


def test_two_way_fill_reaches_back_and_invents_nothing(spark):
    data = [("s", i, 5.0 if 10 <= i < 20 else None) for i in range(60)] + [("t", i, None) for i in range(5)]
    out = {(r["k"], r["i"]): (r["filled"], r["state"]) for r in tracks.two_way_fill(spark.createDataFrame(data, "k string, i long, x double"), ["k"], "i", "x").collect()}
    assert out["s", 0] == (5.0, "propagated") and out["s", 15] == (5.0, "real") and out["s", 34] == (5.0, "propagated") and out["s", 50] == (None, "absent") and out["t", 3] == (None, "absent")


def test_hysteresis_and_grip(spark):
    data = [("s", i, x) for i, x in enumerate("LLRLRRRL")]
    out = tracks.hysteresis(spark.createDataFrame(data, "k string, i long, l string"), ["k"], "i", "l").orderBy("i").collect()
    assert "".join(r["stable"] for r in out) == "LLLLLLRR"
    g = [("s", i, f, None, p) for i, (f, p) in enumerate([(100.0, 50.0), (300.0, 50.0), (0.0, 10.0), (0.0, 10.0), (0.0, 30.0), (0.0, 10.0), (0.0, 5.0), (0.0, 0.0)])]
    out = tracks.grip_events(spark.createDataFrame(g, "k string, i long, a double, b double, p double"), ["k"], "i", "a", "b", "p").orderBy("i").collect()
    assert [(r["i"], r["event"]) for r in out] == [(1, "triggered"), (7, "released")]


def test_slots_keep_hands_apart_when_labels_flip(spark):
    data = []
    for i in range(10):
        data += [("s", i, 0.1 + 0.01 * i, 0.5, "left" if i != 4 else "right"), ("s", i, 0.8 - 0.01 * i, 0.5, "right")]
    out = tracks.slots(spark.createDataFrame(data, "k string, i long, x double, y double, l string"), ["k"], "i", "x", "y", "l").collect()
    assert all((r["x"] < 0.45) == (r["slot"] == 0) for r in out) and {r["slot_label"] for r in out if r["slot"] == 0} == {"left"}


def test_slots_take_the_nearest_of_all_detections(spark):
    data = [("s", 0, 0.1, 0.5, "left"), ("s", 0, 0.8, 0.5, "left"), ("s", 1, 0.4, 0.9, "x"), ("s", 1, 0.45, 0.9, "x"), ("s", 1, 0.81, 0.5, "x"), ("s", 1, 0.11, 0.5, "x")]
    out = tracks.slots(spark.createDataFrame(data, "k string, i long, x double, y double, l string"), ["k"], "i", "x", "y", "l").collect()
    assert sorted((r["i"], r["slot"], r["x"], r["slot_label"]) for r in out) == [(0, 0, 0.1, "left"), (0, 1, 0.8, "right"), (1, 0, 0.11, "left"), (1, 1, 0.81, "right")]


def test_cheapest_pairs():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for rows, columns in ((1, 2), (2, 2), (4, 2), (3, 3), (5, 3)):
        c = rng.random((rows, columns))
        m = min(rows, columns)
        want = min(sum(c[i, j] for i, j in zip(a, b)) for a in permutations(range(rows), m) for b in permutations(range(columns), m))
        got = tracks.cheapest(c)
        assert len(got) == m and abs(sum(c[i, j] for i, j in got) - want) < 1e-12


def test_tactile_baseline_and_lone_cells(spark):
    base = [1000.0] * 256
    press = list(base)
    for c in (17, 18, 33):
        press[c] += 5000
    lone = list(base)
    lone[200] += 1500
    data = [("s", i, base) for i in range(30)] + [("s", 30, press), ("s", 31, lone)]
    out = tracks.tactile_clean(spark.createDataFrame(data, "k string, i long, v array<double>"), ["k"], "i", "v").orderBy("i").collect()
    assert [r["i"] for r in out] == [30, 31] and sum(x > 0 for x in out[0]["clean"]) == 3 and out[1]["clean"][200] == 0.0


def test_tactile_dynamic_gate(spark):
    base, press = [0.0] * 256, [0.0] * 256
    for c in (17, 18, 33, 100, 101):
        press[c] = 1000.0 if c < 50 else 200.0
    data = [("s", i, base) for i in range(30)] + [("s", 30, press)]
    df = spark.createDataFrame(data, "k string, i long, v array<double>")
    count = lambda **o: sum(x > 0 for x in tracks.tactile_clean(df, ["k"], "i", "v", gate=100.0, **o).first()["clean"])
    assert count() == 5 and count(dynamic=0.5) == 3


def test_gating():
    p, q = np.zeros((21, 3)), np.zeros((21, 3))
    q[3] = 1.0
    out, wholesale = tracks.gated_points(q, p)
    assert np.isnan(out[3]).all() and not wholesale
    assert tracks.gated_points(q + 1, p)[1] is True or tracks.gated_points(q + 1, p)[1] == np.True_


def test_repaired_times_increase(spark):
    data = [("s", i, t) for i, t in enumerate([10, 50, 50, 40, 130, None, 120, 170])]
    out = tracks.monotone(spark.createDataFrame(data, "k string, i long, t long"), ["k"], "i", "t", 40).orderBy("i").collect()
    assert [r["repaired"] for r in out] == [10, 50, 90, 130, 170, None, 210, 250]
