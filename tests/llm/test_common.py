"""Joins with hot keys, components, groups, and where intermediate tables go."""

import random
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinetable.llm import common


@pytest.mark.parametrize("hot", [5, 10_000])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_hot_and_null_keys_are_joined_like_others(spark, monkeypatch, hot, how):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rng = random.Random(1)
    rows = [(i, 1 if i % 3 == 0 else None if i % 7 == 0 else rng.randrange(2, 40)) for i in range(300)]
    side = [(k, f"v{k}") for k in range(30)]
    df, s = spark.createDataFrame(rows, "i int, k int").repartition(5), spark.createDataFrame(side, "k int, v string")
    got = sorted((r["i"], r["k"], r["v"]) for r in common.salted_join(df, s, "k", how).collect())
    known = dict(side)
    assert got == sorted((i, k, known.get(k)) for i, k in rows if how == "left" or k in known)
    counts = df.groupBy("k").agg(F.count("*").alias("n"))
    assert sorted(r["i"] for r in common.salted_join(df, s, "k", how, counts).collect()) == [i for i, *_ in got]


@pytest.mark.parametrize("edges", [3, 1_000_000])
def test_components_of_chains_stars_and_cliques(spark, monkeypatch, edges):
    monkeypatch.setattr(common, "EDGES", edges)
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(300, 300 + i) for i in range(1, 40)] + [(500 + i, 500 + j) for i in range(12) for j in range(i)]
    pairs += [(7, 7), (9, 8)]
    rng.shuffle(pairs)
    df = spark.createDataFrame([p if rng.random() < 0.5 else p[::-1] for p in pairs], "a long, b long").repartition(4)
    got = {r["node"]: r["label"] for r in common.components(df).collect()}
    want = {**{i: 100 for i in range(100, 161)}, **{i: 300 for i in range(300, 340)}, **{500 + i: 500 for i in range(12)}, 8: 8, 9: 8}
    got.pop(7, None)  # a link with itself joins nothing
    assert got == want
    assert common.components(df.limit(0)).count() == 0


def test_groups_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        df = spark.createDataFrame([(k, i) for k in range(5) for i in range(k * 3)], "k long, i long")
        out = common.by_group(df, "k", lambda t: [pa.RecordBatch.from_arrays([t.column("k").slice(0, 1).combine_chunks(), pa.array([t.num_rows])], names=["k", "n"])], "k bigint, n bigint")
        assert {r["k"]: r["n"] for r in out.collect()} == {k: k * 3 for k in range(1, 5)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_local_folder_on_a_cluster():
    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: folder), sparkContext=SimpleNamespace(master=master))

    assert common.shared_dir(session("spark://h:7077", "hdfs:///x/")) == "hdfs:///x" and common.shared_dir(session("local[4]")).startswith("file://")
    with pytest.raises(RuntimeError):
        common.shared_dir(session("spark://h:7077"))


def test_batches_of_texts_come_in_pieces(monkeypatch):
    """What is made of long texts isn't held for a whole batch: after its first text a piece has so many bytes at most."""
    monkeypatch.setattr(common, "TEXT_BYTES", 1000)
    texts = ["x" * n for n in (300, 300, 300, 300, 5000, 10, 0, 990)] + [None, "\u00e9" * 400, "y"]
    batch = pa.RecordBatch.from_pydict({"i": list(range(len(texts))), "t": texts})
    own = [p.to_pydict() for p in common.pieces(batch, 1)]
    assert sum((p["t"] for p in own), []) == texts and sum((p["i"] for p in own), []) == list(range(len(texts)))
    assert len(own) > 3 and all(sum(len((t or "").encode()) for t in p["t"][1:]) <= 1000 for p in own)
    assert not list(common.pieces(batch.slice(0, 0), 1))


def test_pieces_of_structs_and_lists(monkeypatch):
    """Texts within structs and lists are cut like plain ones, in slices and beside nulls too."""
    monkeypatch.setattr(common, "TEXT_BYTES", 1000)
    texts = ["x" * n for n in (300, 300, 300, 300, 5000, 10, 0, 990)] + [None, "é" * 400, "y"]
    pairs = [{"html": t, "wrappers": None if i % 3 else b"ab"} for i, t in enumerate(texts)] + [None]
    lists = [None, [], *([{"layout": i, "reference": None if t is None else t.encode(), "template": [{"node": 1, "hash": i}] * (i % 3)}, None] for i, t in enumerate(texts))]
    pair = pa.struct([("html", pa.string()), ("wrappers", pa.binary())])
    item = pa.struct([("layout", pa.int64()), ("reference", pa.binary()), ("template", pa.list_(pa.struct([("node", pa.int32()), ("hash", pa.int64())])))])
    for rows, kind, bytes_of in (
        (pairs, pair, lambda r: len(((r or {}).get("html") or "").encode())),
        (lists, pa.list_(item), lambda r: sum(len(e["reference"] or b"") for e in r or () if e)),
    ):
        whole = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows, kind)], names=["i", "t"])
        for start in (0, 3):
            own = [p.to_pydict() for p in common.pieces(whole.slice(start), 1)]
            assert sum((p["t"] for p in own), []) == rows[start:] and sum((p["i"] for p in own), []) == list(range(start, len(rows)))
            assert len(own) > 2 and all(sum(map(bytes_of, p["t"][1:])) <= 1000 for p in own)
        assert not list(common.pieces(whole.slice(0, 0), 1))
    for values, kind in (([1, None, 3], pa.int64()), ([None, [("a", "b")]], pa.map_(pa.string(), pa.string())), ([None, None], pa.null())):
        batch = pa.RecordBatch.from_arrays([pa.array(values, kind)], names=["t"])
        assert [p.to_pydict()["t"] for p in common.pieces(batch, 0)] == [values]


def test_functions_over_structs_and_lists(spark):
    df = spark.createDataFrame([(1, "a", ["x", None]), (2, None, None), (3, "ccc", [])], "i long, t string, l array<string>")
    one = df.select("i", F.struct("t", F.col("i").alias("n")).alias("s"))
    got = common.map_texts(one, ["i"], "o string", lambda rows: [[f"{r['n']}{r['t']}" for r in rows]], "s").collect()
    assert sorted(map(tuple, got)) == [(1, "1a"), (2, "2None"), (3, "3ccc")]
    got = common.map_texts(df.select("i", "l"), ["i"], "o int", lambda rows: [[None if r is None else len(r) for r in rows]], "l").collect()
    assert sorted(map(tuple, got)) == [(1, 2), (2, None), (3, 0)]
