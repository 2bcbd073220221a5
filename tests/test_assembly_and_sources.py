import json
import struct

import pytest
from pyspark.sql import functions as F

from kinetable.operators import assembly, rollups
from kinetable.plans import workflow as W
from kinetable.sources import datasets, logs


def test_fill_by_name(spark):
    df = spark.createDataFrame([(None, None, None, None, [1.0, None])], "imu_valid boolean, hand_fingers int, hand_source string, x double, v array<double>")
    assert tuple(assembly.filled(df).first()) == (False, -1, "", 0.0, [1.0, 0.0])
    assert dict(assembly.narrowed(df).dtypes)["v"] == "array<float>"


def test_constant_columns(spark):
    nan = float("nan")
    data = [(i, nan, -1, 0.0, "", "Left" if i else "", [0.5], [float(i)]) for i in range(4)]
    df = spark.createDataFrame(data, "frame int, a_reprojection_error double, a_fingers int, a_gesture_score double, a_gesture string, a_handedness string, action array<double>, pose array<double>")
    assert assembly.constant_columns(df) == ["a_reprojection_error", "a_fingers", "a_gesture_score", "a_gesture", "a_handedness", "action"]
    assert assembly.constant_columns(df.limit(0)) == []
    assert assembly.fixed_length(df) == ["action", "pose"]


def test_padding_and_samples(spark):
    df = spark.createDataFrame([([1.0], [[1.0, 2.0]], [5]), ([1.0, 2.0], None, None)], "f_matrix array<double>, imu array<array<double>>, ts array<bigint>")
    assert [len(r["f_matrix"]) for r in assembly.padded_columns(df).collect()] == [2, 2]
    out = assembly.flat_samples(df, "imu", "ts").collect()
    assert [len(r["imu"]) for r in out] == [18, 18] and [r["ts"] for r in out] == [[5, 0, 0], [0, 0, 0]]


def test_propagated_slots_and_splits(spark):
    df = spark.createDataFrame([("real", 1.0), ("propagated", 2.0), (None, 3.0)], "state string, x double")
    assert [r["x"] for r in assembly.unpropagated(df, {"state": ["x"]}).collect()] == [1.0, None, 3.0]
    e = spark.createDataFrame([(i,) for i in range(10)], "i long")
    assert [r["split"] for r in assembly.split(e, "i", 0.75).orderBy("i").collect()] == ["train"] * 7 + ["val"] * 3
    assert [r["split"] for r in assembly.split(e, "i", 0.75, width=3).orderBy("i").collect()] == ["train"] * 7 + ["val"] * 3
    assert assembly.split(e.limit(1), "i", 0.1).first()["split"] == "train" and assembly.split(e.limit(0), "i").count() == 0
    assert {r["split"] for r in assembly.hashed_split(e, "i", 0.5).collect()} <= {"train", "val"}


def test_fingerprints_tell_content_not_names(spark):
    rows = [("a", 1, i, float(i)) for i in range(5)] + [("b", 2, i, float(i)) for i in range(5)] + [("c", 3, i, float(i + (i == 4))) for i in range(5)]
    out = {r["k"]: r["fingerprint"] for r in assembly.fingerprint(spark.createDataFrame(rows, "k string, episode_index long, i long, x double"), ["k"], ["i"]).collect()}
    assert out["a"] == out["b"] != out["c"]


def test_dataset_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}/set"
    frames = spark.createDataFrame([(e, i, i / 30) for e, n in ((0, 10), (1, 20), (1007, 30)) for i in range(n)], "episode_index long, frame_index long, timestamp double")
    datasets.write_chunked(frames, f"{root}/data")
    back = spark.read.parquet(f"{root}/data")
    assert back.filter("chunk = 1").select("episode_index").distinct().first()[0] == 1007 and back.count() == 60
    flat = f"{root}-flat"
    frames.write.parquet(f"{flat}/data")
    assert datasets.read_frames(spark, flat, 1, ["episode_index", "missing"]).filter("missing is null").count() == 20
    episodes = spark.createDataFrame([(0, 10), (1, 21), (5, 3)], "episode_index long, length long")
    problems = {r["episode_index"]: r["problem"] for r in datasets.verified(frames, episodes).collect()}
    assert problems == {1: "length differs", 5: "no frames", 1007: "no episode"}
    assert datasets.with_defaults(episodes).first()["drop_stats"] == "{}"
    datasets.write_meta(spark, root, {"fps": 30}, spark.createDataFrame([("pick", 0)], "task string, task_index long"))
    assert json.loads((tmp_path / "set/meta/info.json").read_text()) == {"fps": 30}
    assert (tmp_path / "set/meta/tasks.jsonl").read_text() == '{"task": "pick", "task_index": 0}\n'
    spark.range(3).write.parquet(f"{root}-staged")
    datasets.swapped(spark, f"{root}-staged", root)
    assert spark.read.parquet(root).count() == 3
    assert datasets.synthesized(episodes, 30.0).count() == 34


def test_files_of_a_dataset_do_not_grow_with_its_episodes(spark, tmp_path):
    """Each file has a range of episodes in order, so that readers prune by its statistics; a long one is spread."""
    frames = spark.createDataFrame([(e, i) for e in range(990, 1290) for i in range(3)] + [(1100, i) for i in range(3, 900)], "episode_index long, frame_index long").repartition(5)
    datasets.write_chunked(frames, f"file://{tmp_path}/set")
    files = sorted(tmp_path.glob("set/chunk=*/*.parquet"))
    assert 2 <= len(files) < 20 and {f.parent.name for f in files} == {"chunk=0", "chunk=1"}
    from pyarrow import parquet

    ranges = []
    for f in files:
        own = parquet.ParquetFile(f).read().to_pylist()  # as it lies in the file
        keys = [(r["episode_index"], r["frame_index"]) for r in own]
        assert keys == sorted(keys)
        ranges.append((keys[0], keys[-1]))
    ranges.sort()
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    assert spark.read.parquet(f"file://{tmp_path}/set").count() == frames.count()


def test_tables_of_sensors_merge_into_the_widest(spark):
    a = spark.createDataFrame([(0, 1), (1, 2)], "frame_index long, x long")
    b = spark.createDataFrame([(0, 1, 5), (1, 2, 6)], "frame_index long, x long, y long")
    c = spark.createDataFrame([(1, 9)], "frame_index long, z long")
    assert sorted(tuple(r) for r in datasets.merged_tables([a, b, c]).select("frame_index", "x", "y", "z").collect()) == [(0, 1, 5, None), (1, 2, 6, 9)]


def test_logs_and_packets(spark, tmp_path):
    (tmp_path / "a.log").write_text('{"msg": "step 5 dt=1.5", "ts": 2.0}\nplain step 6 dt=2.5\n{"msg": torn\n')
    lines = logs.read_lines(spark, str(tmp_path / "a.log"))
    out = logs.extracted(lines, r"step (\d+) dt=([0-9.]+)", ["step", "dt"]).orderBy("step").collect()
    assert [(r["step"], r["dt"], r["ts"]) for r in out] == [("5", "1.5", 2.0), ("6", "2.5", None)]
    assert {r["kind"]: r["lines"] for r in logs.line_classes(lines, {"step": "step"}).collect()} == {"step": 2, "other": 1}
    (tmp_path / "p.bin").write_bytes(struct.pack("<IH", 7, 3) + b"abc" + struct.pack("<IH", 8, 0) + struct.pack("<IH", 9, 50) + b"x")
    got = logs.read_packets(spark, str(tmp_path / "p.bin"), "<IH", ["id", "size"], "size").orderBy("seq").collect()
    assert [(r["id"], bytes(r["payload"])) for r in got] == [(7, b"abc"), (8, b"")]
    (tmp_path / "t.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sorted(r["a"] for r in datasets.read_jsonl(spark, str(tmp_path / "t.jsonl"), "a long").collect() if r["a"] is not None) == [1, 2]


def test_force_matrices_round_trip(spark):
    m = [float((i * 37) % 500 - 250) for i in range(4 * 3 * 2)]
    df = spark.createDataFrame([(0, m), (1, None)], "i int, v array<double>")
    back = logs.decoded_matrix(logs.encoded_matrix(df, "v", 4, 3, 2, 100.0), "v", 4, 3, 2, 100.0).orderBy("i").collect()
    assert back[0]["v"] == m and back[1]["v"] is None


def test_rollups(spark):
    b = spark.createDataFrame([(1, "x", 5, 10), (2, "y", 0, 0)], "id int, name string, count int, target int")
    o = spark.createDataFrame([(1, "x", 8, 3), (3, "z", 0, 0), (4, "y", 2, 0)], "id int, name string, count int, synced int")
    got = {r["name"]: (r["id"], r["shown"], r["status"]) for r in rollups.merged_tasks(b, o, "id", "name").collect()}
    assert got == {"x": (1, 10, "completed"), "y": (2, 0, "pending"), "z": (3, 0, "pending")}
    s = spark.createDataFrame([("front_left",), ("front_right",), ("wrist",)], "n string")
    assert {r["base"]: r["stereo"] for r in rollups.groups_by_prefix(s, "n").collect()} == {"front": True, "wrist": False}
    jobs = spark.createDataFrame([(1, "queued", "2024-01-02", None), (2, "running", "2024-01-01", "2024-01-03"), (3, "running", "2024-01-01", "2024-02-01"), (4, "done", "2024-01-01", None)], "id int, status string, created_at string, lease_until string").withColumn("lease_until", F.col("lease_until").cast("timestamp"))
    assert [r["id"] for r in rollups.claimable(jobs, "2024-01-15").collect()] == [2, 1]
    old = spark.createDataFrame([("e", "a", 4)], "episode string, id string, sort_order int")
    new = spark.createDataFrame([("e", "a", "l", 0, 5), ("e", "b", "l", 9, 12), ("e", "c", "l", 6, 8), ("e", "d", " ", 0, 3), ("e", "f", "l", 3, 3)], "episode string, id string, label string, start_frame int, end_frame int")
    assert {r["id"]: r["sort_order"] for r in rollups.imported_actions(old, new, ["episode"]).collect()} == {"c": 5, "b": 6}
    flips = spark.createDataFrame([("e", i, x) for i, x in enumerate(["L", "", "L", "R", "R", "L"])], "e string, i int, l string")
    assert rollups.fingers_flips(flips, ["e"], "i", "l").first()["flips"] == 2
    tables, counts = rollups.renamed({"a": (flips, "e"), "b": (old, "episode")}, "e", "new")
    assert {r["store"]: r["changed"] for r in counts.collect()} == {"a": 6, "b": 1} and tables["b"].first()["episode"] == "new"
    assert rollups.of_status(spark.createDataFrame([("completed",), ("to_review",), ("failed",)], "s string"), "s", ["to_review"]).count() == 2


@pytest.fixture
def kinds():
    keep, aliases = dict(W.KINDS), dict(W.ALIASES)
    W.KINDS.clear()

    @W.node_kind("source", "input")
    def source(inputs, config):
        return {"out": inputs["given"]}

    @W.node_kind("scale", "process", ("frames",), aliases=("old_scale",), factor=2)
    def scale(inputs, config):
        return {"out": inputs["frames"].withColumn("x", F.col("x") * config["factor"])}

    @W.node_kind("join", "export", ("frames",))
    def join(inputs, config):
        first, *rest = [inputs[k] for k in sorted(inputs)]
        for r in rest:
            first = first.unionByName(r)
        return {"out": first}

    @W.node_kind("skips", "process", ("frames",))
    def skips(inputs, config):
        raise W.Skip

    yield
    W.KINDS.clear()
    W.KINDS.update(keep)
    W.ALIASES.clear()
    W.ALIASES.update(aliases)


def test_workflow(spark, kinds):
    nodes = [W.Node("j", "join"), W.Node("b", "old_scale", {"factor": 3}), W.Node("a", "scale"), W.Node("s", "source"), W.Node("k", "skips"), W.Node("z", "join")]
    edges = [W.Edge("s", "out", "a", "frames"), W.Edge("s", "out", "b", "frames"), W.Edge("a", "out", "j", "frames"), W.Edge("b", "out", "j", "frames"), W.Edge("s", "out", "k", "frames"), W.Edge("k", "out", "z", "frames")]
    made, state = W.execute(nodes, edges, {"s": spark.createDataFrame([(1,)], "x long")}, {"a": {"factor": 10}})
    assert sorted(r["x"] for r in made["j", "out"].collect()) == [3, 10]
    assert state == {"s": "done", "a": "done", "b": "done", "j": "done", "k": "skipped", "z": "skipped"}
    assert W.revision(nodes, edges) == W.revision(nodes[::-1], edges[::-1]) != W.revision(nodes[1:], edges)
    assert W.upstream("j", nodes, edges) == ["s"]
    cycle = W.in_order([W.Node("p", "scale"), W.Node("q", "scale"), W.Node("r", "source")], [W.Edge("p", "out", "q", "frames"), W.Edge("q", "out", "p", "frames")])
    assert [n.id for n in cycle] == ["r", "p", "q"]
    grown, links = W.completed([W.Node("a", "scale")], [], {"cam": "source", "aux": "source"}, {"source": "scale"})
    assert [n.id for n in grown] == ["a", "input_aux", "input_cam", "scale_cam"] and len(links) == 2
    runs = spark.createDataFrame([("e1", "r1", "completed"), ("e2", "r0", "completed"), ("e3", "r1", "failed")], "episode_id string, revision string, status string")
    eps = spark.createDataFrame([("e1",), ("e2",), ("e3",)], "episode_id string")
    assert sorted(r[0] for r in W.to_run(eps, runs, "r1").collect()) == ["e2", "e3"]
