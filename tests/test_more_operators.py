"""Operators that no registered query shows whole: names, documents, pairs, fingerprints of files."""

import json
import math

import numpy as np
from pyspark.sql import functions as F

from kinetable.operators import assembly, poses, rollups, tracks
from kinetable.sources import datasets


def test_pose_columns_of_each_camera():
    names = ["observation.slam_pose", "observation.slam_trajectory", "observation.gripper_2_slam_pose", "observation.slam_trajectory_ns", "processing.slam.data_4.action", "x"]
    assert assembly.pose_columns(names) == {"": "observation.slam_trajectory", "gripper_2": "observation.gripper_2_slam_pose"}


def test_poses_and_states_are_made_where_they_are_missing(spark):
    rows = [(1, i, i / 30, [500 + i / 30.0, float(i), 0.0, 0.0, 0.0, 0.0, 0.0, 1.0], [50.0 if i else float("nan")]) for i in range(6)]
    schema = "episode_index int, frame_index int, timestamp double, `observation.slam_trajectory` array<double>, `observation.gripper_state` array<double>"
    out = assembly.with_pose_and_state(spark.createDataFrame(rows, schema)).orderBy("frame_index").collect()
    assert np.allclose([r["observation.slam_pose"][0] for r in out], range(6), atol=1e-6)
    assert np.allclose(out[2]["observation.state"], [2, 0, 0, 0.5], atol=1e-6) and out[0]["observation.state"][3] == 0.0
    there = spark.createDataFrame(rows, schema).withColumn("observation.state", F.array(F.lit(7.0)))
    again = assembly.with_pose_and_state(there)
    assert {r["observation.state"][0] for r in again.collect()} == {7.0}


def test_documents_lose_empty_parts_only():
    assert rollups.without_empty({"a": {}, "b": {"c": [], "d": [{}, 1]}, "e": None, "f": 0}) == {"b": {"d": [1]}, "e": None, "f": 0}
    assert rollups.without_empty({"a": {"b": {}}}) is None and rollups.without_empty([]) is None


def test_names_of_one_source():
    assert rollups.same_source("observation.images.Cam-left_rgb", "cam_left.mp4") and not rollups.same_source("cam_left", "cam_right")


def test_two_hands_of_either_side(spark):
    rows = [(0, "a", "x", 20, 2.0, True), (0, "a", "y", 21, 1.0, False), (0, "b", "x", 15, 1.0, False), (0, "b", "y", 21, 9.0, True), (1, "a", "x", 5, 0.0, True)]
    df = spark.createDataFrame(rows, "f int, l string, r string, n int, e double, s boolean")
    got = sorted((r["l"], r["r"], r["rank"]) for r in poses.paired_hands(df, ["f"], "l", "r", "n", "e", "s").collect())
    assert got == [("a", "y", 1), ("b", "x", 2)]


def test_rigid_fit_of_single_pairs_and_repeats(spark):
    t = np.linspace(0, 4, 30)
    a = np.stack([t, np.sin(3 * t), np.cos(t)], 1)
    turn = np.array([[math.cos(1), -math.sin(1), 0], [math.sin(1), math.cos(1), 0], [0, 0, 1]])
    rng = np.random.default_rng(2)
    b = a @ turn.T + [3, -1, 2] + rng.normal(size=a.shape) * 0.01
    df = spark.createDataFrame([("k", float(x), p.tolist(), q.tolist()) for x, p, q in zip(t, a, b)], "k string, t double, p array<double>, q array<double>")
    r = poses.trajectory_errors(df, ["k"], "t", "p", "q").first()
    ca, cb = a.mean(0), b.mean(0)
    u, _, vt = np.linalg.svd((a - ca).T @ (b - cb))
    on = (a - ca) @ (vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T).T + cb
    e = np.linalg.norm(on - b, axis=1)
    j = np.searchsorted(t, t + 1)
    i = np.flatnonzero(j < len(t))
    rel = np.linalg.norm((on[j[i]] - on[i]) - (b[j[i]] - b[i]), axis=1)
    want = [np.sqrt((e**2).mean()), e.mean(), np.median(e), np.percentile(e, 95), e.max(), np.sqrt((rel**2).mean()), e[-1]]
    assert np.allclose([r[c] for c in ("ate_rmse", "ate_mean", "ate_median", "ate_p95", "ate_max", "rpe_rmse", "end_error")], want, atol=1e-8)


def test_points_are_gated_unless_most_are_off(spark):
    p, q = [[0.0, 0.0, 0.0]] * 9 + [[9.0, 0.0, 0.0]], [[0.0, 0.0, 0.1]] * 10
    df = spark.createDataFrame([(1, p, q), (2, [[5.0, 0.0, 0.0]] * 10, q), (3, p, None)], "id int, p array<array<double>>, q array<array<double>>")
    got = {r["id"]: (math.isnan(r["p"][9][0]), r["p"][0][0], r["wholesale"]) for r in tracks.gated(df, "p", "q").collect()}
    assert got == {1: (True, 0.0, False), 2: (False, 5.0, True), 3: (False, 0.0, False)}


def test_statistics_of_episodes_are_lines(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", [1.0], [0.0], [1.0], [1.0], [1]), (1, "a", [2.0], [0.0], [2.0], [2.0], [1])], "episode_index int, feature string, mean array<double>, std array<double>, min array<double>, max array<double>, count array<long>")
    datasets.write_episode_stats(f"file://{tmp_path}", df)
    lines = [json.loads(x["value"]) for x in spark.read.text(f"file://{tmp_path}/meta/episodes_stats").collect()]
    assert sorted(x["mean"] for x in lines) == [[1.0], [2.0]] and {x["feature"] for x in lines} == {"a"}


def test_a_sample_of_files_with_its_scale(spark, tmp_path):
    spark.range(900).repartition(9).write.parquet(f"{tmp_path}/x")
    own, scale = datasets.sampled(spark.read.parquet(f"{tmp_path}/x"))
    assert scale == 3.0 and own.count() * scale == 900


def test_like_patterns_and_axes(spark):
    df = spark.createDataFrame([("a.b_1",), ("axb_1",), ("a.b",)], "n string")
    assert [r["n"] for r in df.filter(rollups.like_pattern(F.col("n"), "a.b_?")).collect()] == ["a.b_1"]


def test_points_are_labelled_in_two_passes(spark):
    def hand(x, odd=None, by=0.5):
        p = [[x + 0.01 * j, 0.0, 1.0] for j in range(21)]
        if odd is not None:
            p[odd] = [p[odd][0] + by, 0.0, 1.0]
        return p

    steady = [hand(0.0)] * 10
    cases = {
        "lead": [None] * 20 + steady,  # fifteen frames before the first are predicted back
        "gap": steady + [None] * 3 + steady,
        "flash": steady + [hand(3.0)] + steady,  # one frame elsewhere
        "moved": steady + [hand(3.0)] * 6,
        "latched": steady + [hand(0.0, odd=4)] * 8,
        "never": [None] * 5,
    }
    rows = [(k, i, p) for k, ps in cases.items() for i, p in enumerate(ps)]
    out = tracks.labelled_points(spark.createDataFrame(rows, "k string, i long, p array<array<double>>"), ["k"], "i", "p").collect()
    got = {(r["k"], r["i"]): r for r in out}
    state = lambda k: "".join(got[k, i]["state"][0] for i in range(len(cases[k])))
    assert state("lead") == "a" * 5 + "p" * 15 + "r" * 10 and state("gap") == "r" * 10 + "ppp" + "r" * 10 and state("never") == "a" * 5
    assert state("flash") == "r" * 10 + "p" + "r" * 10 and abs(got["flash", 10]["tracked"][0][0]) < 1e-9
    assert state("moved") == "r" * 10 + "p" + "r" * 5 and abs(got["moved", 11]["tracked"][0][0] - 3.0) < 1e-9  # the second agrees
    x = [got["latched", i]["tracked"][4][0] for i in range(10, 18)]
    assert all(abs(v - 0.04) < 1e-9 for v in x[:4]) and x[4] > 0.2  # taken back after five frames


def test_sources_go_to_one_kind_each():
    from kinetable.plans.workflow import Claim, claimed

    claims = [Claim("glove", ("left_glove", "right_glove")), Claim("stereo", words=("stereo",)), Claim("gripper", words=("gripper", "umi"), every=True), Claim("mono", without=("glove", "imu", "depth")), Claim("other", ("nothing",))]
    got = claimed({"Left_Glove_Joint", "umi_state", "gripper_force", "head_stereo_rgb", "ego_rgb", "imu_left"}, claims)
    assert got == {"glove": ["left_glove_joint"], "stereo": ["head_stereo_rgb"], "gripper": ["gripper_force", "umi_state"], "mono": ["ego_rgb"], "other": []}
