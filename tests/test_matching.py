import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.operators import matching, rollups, tracks
from kinetable.operators.matching import Claim
from kinetable.plans.workflow import claimed


def greedy(pairs):
    out, left, right = [], set(), set()
    for cost, a, b in sorted((c, a, b) for a, b, c in pairs if c is not None):
        if a not in left and b not in right:
            out.append((a, b, cost))
            left.add(a)
            right.add(b)
    return sorted(out)


def test_mutual_matches_are_the_greedy_ones(spark):
    rng = random.Random(2)
    rows = [(k, a, b, rng.choice((None, 1.0, 2.0, round(rng.random(), 2)))) for k in ("x", "y", None) for a in range(12) for b in range(9) if rng.random() < 0.7]
    chain = [("chain", i, j, float(2 * i + (j > i))) for i in range(8) for j in (i, i + 1)]
    got = matching.mutual_matches(spark.createDataFrame(rows + chain, "k string, a int, b int, c double"), ["k"], "a", "b", "c").collect()
    for key in ("x", "y", None, "chain"):
        own = [(a, b, c) for k, a, b, c in rows + chain if k == key]
        assert sorted((r["a"], r["b"], r["c"]) for r in got if r["k"] == key) == greedy(own)
    assert matching.mutual_matches(spark.createDataFrame([], "a int, b int, c double"), [], "a", "b", "c").collect() == []


def test_claims_equal_those_of_one_set(spark):
    rng = random.Random(4)
    words = ["stereo_left", "stereo_right", "Left_Glove", "right_glove", "imu", "d435_depth", "head_rgb", "gripper_a", "umi_b", "left"]
    claims = [Claim("glove", ("left_glove", "right_glove")), Claim("stereo", words=("stereo",)), Claim("gripper", words=("gripper", "umi"), every=True), Claim("mono", without=("glove", "imu", "depth")), Claim("rest", every=True), Claim("nothing")]
    sets = {k: rng.sample(words, rng.randrange(1, len(words))) for k in range(30)}
    df = spark.createDataFrame([(k, s) for k, own in sets.items() for s in own] + [(0, None)], "k int, s string")
    got = {}
    for r in matching.claimed_sources(df, ["k"], "s", claims).collect():
        got.setdefault(r["k"], {})[r["kind"]] = r["sources"]
    assert got == {k: claimed(set(own), claims) for k, own in sets.items()}


SCHEMA = "frame long, hand string, label string, place array<double>, wrist array<double>"


def slots_of(spark, rows, **options):
    df = spark.createDataFrame([("k", *r, r[-1]) for r in rows], "k string, frame long, hand string, label string, place array<double>, wrist array<double>")
    return {(r["frame"], r["hand"]): r["slot"] for r in matching.mono_slots(df, ["k"], "frame", "hand", "label", "place", "wrist", **options).collect()}


def test_slots_of_crossing_hands(spark):
    rows = []
    for f in range(40):
        rows += [(f, "a", "Left", [-0.4 + f * 0.02, 0.0, 0.5]), (f, "b", "Right", [0.4 - f * 0.02, 0.0, 0.55])]
    got = slots_of(spark, rows)
    assert all(got[f, "a"] == 0 and got[f, "b"] == 1 for f in range(40))
    # Without labels, places alone keep them apart.
    got = slots_of(spark, [(f, h, None, p) for f, h, _, p in rows])
    assert all(got[f, "a"] == got[0, "a"] and got[f, "b"] == 1 - got[0, "a"] for f in range(40))


def test_a_lost_slot_takes_its_label_back_from_afar(spark):
    rows = [(f, "a", "Left", [0.01 * f, 0.0, 0.5]) for f in range(6)] + [(f, "b", "Right", [0.5, 0.0, 0.5]) for f in range(20)]
    rows += [(f, "a", "Left", [-0.8, 0.3, 0.5]) for f in range(12, 20)]  # far beyond the gate, but its slot has no hand
    got = slots_of(spark, rows)
    assert all(got[f, "a"] == 0 for f in range(12, 20)) and all(got[f, "b"] == 1 for f in range(20))
    # A label that flickers doesn't take the other's slot, as that has its hand.
    rows = [(f, "a", "Left", [0.0, 0.0, 0.5]) for f in range(6)] + [(f, "b", "Right" if f < 4 else "Left", [0.5, 0.0, 0.5]) for f in range(6)]
    got = slots_of(spark, rows)
    assert got[5, "a"] == 0 and (5, "b") not in got


def test_near_wrists_are_swapped_if_that_is_better():
    slots = [matching.Slot("", np.array([0.0, 0, 0.5]), np.zeros(3), 1), matching.Slot("", np.array([0.06, 0, 0.5]), np.zeros(3), 1)]
    places = np.array([[0.05, 0, 0.5], [0.012, 0, 0.5]])
    assert matching.assigned(slots, 2, ["", ""], places, places, 15) == {0: 1, 1: 0}
    # The nearest pair goes first, which here makes the other far; near wrists allow the swap.
    places = np.array([[0.031, 0, 0.5], [0.1, 0, 0.5]])
    assert matching.assigned(slots, 2, ["", ""], places, places, 15) == {0: 0, 1: 1}
    assert matching.assigned(slots, 2, [], np.empty((0, 3)), np.empty((0, 3)), 15) == {}


def test_hands_after_a_cold_start(spark):
    got = slots_of(spark, [(0, "b", "Right", [0.5, 0.0, 0.5]), (3, "a", "Left", [0.0, 0.0, 0.5]), (4, "c", None, [0.9, 0.9, 0.9])])
    assert got == {(0, "b"): 1, (3, "a"): 0}
    got = slots_of(spark, [(0, "a", None, None), (0, "b", None, [0.5, None, 0.5])])
    assert got == {(0, "a"): 0, (0, "b"): 1}


def test_completed_depths_follow_their_hand(spark):
    hand = lambda z, far: [[0.1 * i, 0.05 * i, z if i < 5 else far] for i in range(8)]
    seen = [True] * 5 + [False] * 3
    rows = [("k", 0, hand(0.5, 0.8), seen, "l"), ("k", 1, hand(0.7, 0.9), seen, "l"), ("k", 2, hand(0.4, 0.9), [True] * 3 + [False] * 5, "l"), ("k", 3, hand(0.9, 0.9), seen, "r"), ("k", 4, None, seen, "r")]
    df = spark.createDataFrame(rows, "k string, i int, p array<array<double>>, m array<boolean>, l string")
    out = {r["i"]: r["p"] for r in tracks.depth_centred(df, ["k"], "i", "p", "m", "l").collect()}
    assert out[0][7] == pytest.approx([0.7 * 0.5 / 0.8, 0.35 * 0.5 / 0.8, 0.5]) and out[0][4] == pytest.approx([0.4, 0.2, 0.5])
    assert out[1][6][2] == pytest.approx(0.6) and out[1][0][2] == pytest.approx(0.7)  # half of 0.5 and of 0.7
    assert out[2] == [pytest.approx(x) for x in hand(0.4, 0.9)] and out[3][7][2] == pytest.approx(0.9) and out[4] is None


def test_another_label_starts_tracking_anew(spark):
    hand = lambda x: [[x + 0.01 * i, 0.0, 0.5] for i in range(10)]
    rows = [("k", f, hand(0.01 * f), "left") for f in range(5)] + [("k", 5, hand(0.04), "right"), ("k", 6, None, None), ("k", 7, hand(0.04), "right")]
    df = spark.createDataFrame(rows, "k string, i int, p array<array<double>>, l string")
    out = {r["i"]: r for r in tracks.labelled_points(df, ["k"], "i", "p", label="l").collect()}
    assert out[5]["tracked"][0][0] == pytest.approx(0.04) and out[6]["tracked"][0][0] == pytest.approx(0.04)  # no speed is left
    assert out[6]["state"] == "propagated" and out[6]["l"] == "right" and out[4]["l"] == "left"
    plain = {r["i"]: r for r in tracks.labelled_points(df, ["k"], "i", "p").collect()}
    assert plain[6]["tracked"][0][0] != pytest.approx(0.04, abs=1e-6) and "l" not in plain[6]


def test_active_duplicates(spark):
    uploads = spark.createDataFrame([(1, "h", 1000.0), (2, "g", 1000.0), (3, None, 1000.0), (4, "", 1000.0), (5, "x", 1000.0), (6, "y", 1000.0)], "upload int, digest string, at double")
    jobs = [("j2", "h", "queued", 0.0, None), ("j1", "h", "processing", 0.0, None), ("j3", "g", "completed", 950.0, "e1"), ("j4", "x", "completed", 950.0, "gone"), ("j5", "y", "completed", 10.0, "e1"), ("j6", "y", "failed", 999.0, "e1"), ("j7", "", "queued", 1.0, None)]
    out = rollups.active_duplicates(uploads, spark.createDataFrame(jobs, "job string, digest string, status string, created double, episode string"), spark.createDataFrame([("e1",), ("e1",)], "episode string"), 100.0)
    assert {r["upload"]: r["duplicate_of"] for r in out.collect()} == {1: "j1", 2: "j3", 3: None, 4: None, 5: None, 6: None}


def test_first_uploads_of_a_stream(spark, tmp_path):
    from kinetable.streaming import incremental

    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:02:00"), (None, "2024-01-01 00:03:00"), (None, "2024-01-01 00:04:00")]
    df = spark.createDataFrame(rows, "digest string, t string").select("digest", F.to_timestamp("t").alias("t"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = incremental.source(spark, f"{tmp_path}/in", df.schema)
    incremental.appended(incremental.first_uploads(stream, "digest", "t", "1 hour"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(str(r["digest"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["None", "None", "a", "b"]
