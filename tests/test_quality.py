import pytest
from pyspark.sql import functions as F

from kinetable.operators import quality as Q

SCHEMA = "episode_id string, stream string, frame_index long, values array<double>"


def one(df):
    return {(r["episode_id"], r["stream"]): r["status"] for r in df.collect()}


def test_video_rules(spark):
    schema = "episode_id string, reason string, decode_errors long, duration double, black_ranges array<struct<start:double,end:double>>, freeze_ranges array<struct<start:double,end:double>>, frame_count long, rows long"
    p = spark.createDataFrame(
        [("ok", None, 0, 100.0, [], [], 300, 300), ("bad", None, 3, 100.0, [(0.0, 6.0)], [(0.0, 12.0)], 200, 300), ("warn", None, 0, 100.0, [(0.0, 0.4), (1.0, 2.0)], [(0.0, 2.5)], 305, 300), ("none", "decoder_missing", 0, 1.0, [], [], 1, 1), ("open", "open_failed", 0, 1.0, [], [], 1, 1)], schema
    )
    status = lambda df: {r["episode_id"]: r["status"] for r in df.collect()}
    assert status(Q.decode_error(p)) == {"ok": "pass", "bad": "fail", "warn": "pass", "none": "error", "open": "fail"}
    assert status(Q.black_screen(p)) == {"ok": "pass", "bad": "fail", "warn": "warn", "none": "pass", "open": "pass"}
    assert status(Q.freeze(p)) == {"ok": "pass", "bad": "fail", "warn": "warn", "none": "pass", "open": "pass"}
    assert status(Q.frame_drop(p)) == {"ok": "pass", "bad": "fail", "warn": "warn", "none": "pass", "open": "pass"}


def glove(name, n, make):
    return [(name, "left", i, make(i)) for i in range(n)]


def test_glove_rules(spark):
    rows = glove("still", 320, lambda i: [600.0] * 256) + glove("short", 50, lambda i: [700.0 + i] * (256 if i else 255)) + glove("low", 50, lambda i: [float(i + 1)] * 256) + glove("none", 400, lambda i: [0.0] * 256) + glove("run", 100, lambda i: [600.0 + (i if i >= 40 else 0)] * 256)
    df = spark.createDataFrame(rows, SCHEMA)
    get = lambda rule: {k[0]: v for k, v in one(rule(df)).items()}
    assert get(Q.array_shape) == {"still": "pass", "short": "fail", "low": "pass", "none": "pass", "run": "pass"}
    assert get(Q.frozen_array) == {"still": "fail", "short": "pass", "low": "pass", "none": "pass", "run": "warn"}
    assert get(Q.gate_floor) == {"still": "pass", "short": "pass", "low": "fail", "none": "pass", "run": "pass"}
    assert get(Q.no_contact) == {"still": "pass", "short": "pass", "low": "pass", "none": "warn", "run": "pass"}


def test_device_status(spark):
    data = [("a", "s", i, "connected") for i in range(3)] + [("b", "s", i, x) for i, x in enumerate(["connected", "disconnected", "connected"])] + [("c", "s", 0, ""), ("d", "s", 0, "idle")]
    assert {k[0]: v for k, v in one(Q.device_status(spark.createDataFrame(data, "episode_id string, stream string, frame_index long, status string"))).items()} == {"a": "pass", "b": "fail", "c": "warn", "d": "warn"}


def pose(x, q=(0.0, 0.0, 0.0, 1.0)):
    return [x, 0.0, 0.0, *q]


def test_pose_and_action_rules(spark):
    rows = [("smooth", "p", i, pose(0.01 * i)) for i in range(40)]
    rows += [("one", "p", i, pose(0.01 * i + (1.0 if i >= 20 else 0.0))) for i in range(40)]
    rows += [("many", "p", i, pose(float(i % 2))) for i in range(40)]
    rows += [("gaps", "p", i, pose(float(i)) if i % 2 else [0.0] * 7) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {k[0]: v for k, v in one(Q.slam_continuity(df)).items()} == {"smooth": "pass", "one": "warn", "many": "fail", "gaps": "pass"}
    act = [("moves", "a", i, [float(i)]) for i in range(20)] + [("same", "a", i, [3.0]) for i in range(20)] + [("none", "a", i, []) for i in range(20)] + [("part", "a", i, [float(i)] if i < 15 else []) for i in range(20)]
    assert {k[0]: v for k, v in one(Q.action_present(spark.createDataFrame(act, SCHEMA))).items()} == {"moves": "pass", "same": "fail", "none": "fail", "part": "warn"}
    force = [("f", "l", i, [0.0, 0.0, 0.0 if i < 20 else 500.0]) for i in range(40)] + [("g", "l", i, [0.0, 0.0, 1.0]) for i in range(40)]
    assert {k[0]: v for k, v in one(Q.force_baseline(spark.createDataFrame(force, SCHEMA))).items()} == {"f": "warn", "g": "pass"}
    cover = spark.createDataFrame([("e", "p", i, i < n) for n in (0,) for i in range(100)] + [("h", "p", i, i < 12) for i in range(100)], "episode_id string, stream string, frame_index long, interpolated boolean")
    assert {k[0]: v for k, v in one(Q.slam_coverage(cover)).items()} == {"e": "pass", "h": "fail"}
    counts = spark.createDataFrame([("e", "cam0", "rgb", 300), ("e", "imu", "imu", 301), ("e", "slam", "slam", 290)], "episode_id string, stream string, kind string, rows long")
    assert one(Q.av_sync(counts)) == {("e", "imu"): "pass", ("e", "slam"): "fail"}


def test_registry_runs_all_and_reports_failures(spark):
    rows = spark.createDataFrame(glove("a", 5, lambda i: [600.0 + i] * 256), SCHEMA)
    out = Q.run_checks({"glove.array_shape": rows, "glove.no_contact": rows, "video.freeze": rows})
    assert {r["rule"]: r["status"] for r in out.collect()} == {"glove.array_shape": "pass", "glove.no_contact": "pass", "video.freeze": "error"}
    with pytest.raises(ValueError):
        Q.check("glove.no_contact", "1", ())(lambda df: df)
    assert len(Q.revision()) == 24 and Q.revision() != Q.revision({"glove.no_contact": Q.CHECKS["glove.no_contact"]})


def test_applicability_and_modalities(spark):
    e = spark.createDataFrame([("g", ["tactile", "time", "device_status"], ["glove_sensor"]), ("v", ["rgb", "time"], ["mono_rgb"])], "episode_id string, channels array<string>, modalities array<string>")
    got = {(r["episode_id"], r["slug"]) for r in Q.applicable(e, disabled=["video.freeze"]).collect()}
    assert ("g", "glove.frozen_array") in got and ("v", "video.frame_drop") in got and ("v", "video.freeze") not in got and ("v", "glove.no_contact") not in got
    c = e.select(Q.inferred_modalities(F.col("channels"), F.array(F.lit("x"))).alias("m"), Q.channels_for(F.col("modalities")).alias("c")).collect()
    assert c[0]["m"] == ["x", "glove_sensor"] and c[1]["c"] == ["rgb", "time"]


def test_config_timeline_gate_and_legacy(spark):
    d = spark.createDataFrame([("e", "s", "warn", "1"), ("e", "s", "fail", "5")], "episode_id string, slug string, param string, value string")
    o = spark.createDataFrame([("e", "s", "warn", "9", 1), ("e", "s", "warn", "3", 0)], "episode_id string, slug string, param string, value string, device_pos int")
    assert {r["param"]: r["value"] for r in Q.resolved_config(d, o).collect()} == {"warn": "3", "fail": "5"}
    t = spark.createDataFrame([("e", [(1.0, 2.0, "a"), (1.0, 2.0, "a"), (0.0, 1.0, "b")]), ("e", [(1.0, 2.0, "a")])], "episode_id string, ranges array<struct<start_sec:double,end_sec:double,code:string>>")
    assert Q.timeline(t).count() == 2
    s = spark.createDataFrame([("a", "approved"), ("b", "approved"), ("c", "processing")], "episode_id string, status string")
    r = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "episode_id string, blocking boolean")
    assert {x["episode_id"]: (x["status"], x["can_approve"]) for x in Q.gated(s, r).collect()} == {"a": ("to_review", False), "b": ("approved", True), "c": ("processing", False)}
    rows = spark.createDataFrame([("a", i, [float(i)], "connected") for i in range(100)] + [("b", i, [0.0], "connected") for i in range(100)], "episode_id string, frame_index long, values array<double>, status string")
    probes = spark.createDataFrame([("a", 95, True), ("b", 100, True)], "episode_id string, frame_count long, readable boolean")
    assert {x["episode_id"]: x["ok"] for x in Q.legacy_validation(rows, probes).collect()} == {"a": True, "b": False}


def test_a_check_that_fails_at_a_row_leaves_the_others(spark):
    rows = spark.createDataFrame([("e", "s", 0, [1.0] * 256)], "episode_id string, stream string, frame_index int, values array<double>")
    broken = rows.withColumn("values", F.when(F.col("frame_index") == 0, F.raise_error(F.lit("torn")).cast("array<double>")).otherwise(F.col("values")))
    out = {r["rule"]: r["status"] for r in Q.run_checks({"glove.array_shape": rows, "glove.no_contact": broken}).collect()}
    assert out == {"glove.array_shape": "pass", "glove.no_contact": "error"}


def test_long_frozen_streams_are_cut(spark):
    """Runs that cross the cuts are whole, and no window takes a whole stream."""
    lengths = [1, 45, 3, 310, 2, 39, 7] * 2
    values = [v for k, n in enumerate(lengths) for v in [float(k % 5)] * n]
    rows = [(e, "left", i, [v]) for e, own in (("long", values), ("still", [0.0] * 400), ("short", [1.0] * 41)) for i, v in enumerate(own)]
    df = spark.createDataFrame(rows, "episode_id string, stream string, frame_index long, values array<double>").repartition(3)
    cut, whole = (Q.frozen_array(df, most) for most in (50, 10_000))
    of = lambda found: {r["episode_id"]: (r["status"], r["value"]) for r in found.collect()}
    assert of(cut) == of(whole) == {"long": ("fail", 310.0), "still": ("pass", 0.0), "short": ("warn", 41.0)}
    plans = [found._jdf.queryExecution().executedPlan().toString() for found in (cut, whole)]
    assert "_range" in plans[0] and "_range" not in plans[1]
