import random

import pytest

from kinetable.operators import align


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("bucket", [None, 7])
def test_asof_against_brute_force(spark, direction, bucket):
    rng = random.Random(3)
    left = [(rng.randrange(3), rng.randrange(60), i) for i in range(80)]
    right = [(rng.randrange(2), t, i) for i, t in enumerate(rng.sample(range(60), 25))]
    l, r = spark.createDataFrame(left, "k int, t long, id long"), spark.createDataFrame(right, "k int, t long, v long")
    got = {x["id"]: x["r_v"] for x in align.asof(l, r, ["k"], "t", direction, tie="v", bucket=bucket).collect()}
    for k, t, i in left:
        own = [(rt, v) for rk, rt, v in right if rk == k]
        if direction == "backward":
            own = sorted((x for x in own if x[0] <= t), reverse=True)
        elif direction == "forward":
            own = sorted(x for x in own if x[0] >= t)
        else:
            own = sorted(own, key=lambda x: (abs(x[0] - t), x[0]))
        assert got[i] == (own[0][1] if own else None), (k, t)


def test_asof_tolerance_ties_and_empty_sides(spark):
    l = spark.createDataFrame([("a", 10), ("b", 10), (None, 10)], "k string, t long")
    r = spark.createDataFrame([("a", 10, 1), ("a", 10, 2), ("b", 1, 3), (None, 10, 4), ("a", None, 9)], "k string, t long, v long")
    got = {x["k"]: x["r_v"] for x in align.asof(l, r, ["k"], "t", tolerance=5, tie="v").collect()}
    assert got["a"] == 2 and got["b"] is None
    assert align.asof(l.limit(0), r, ["k"], "t").count() == 0
    assert all(x["r_v"] is None for x in align.asof(l, r.limit(0), ["k"], "t").collect())


def test_nearest_valid_skips_missing_readings(spark):
    l = spark.createDataFrame([("a", 10)], "k string, t long")
    r = spark.createDataFrame([("a", 10, float("nan")), ("a", 11, None), ("a", 0, 5.0), ("a", 14, 7.0)], "k string, t long, v double")
    assert align.nearest_valid(l, r, ["k"], "t", "v").first()["r_v"] == 7.0


def test_intervals_include_both_ends_and_the_first_wins(spark):
    p = spark.createDataFrame([("a", t) for t in (0, 5, 9, 10, 30)], "k string, t long")
    i = spark.createDataFrame([("a", 1, 5, 9), ("a", 2, 0, 10), ("a", 3, 9, 8)], "k string, n long, s long, e long")
    assert rows(align.in_intervals(p, i, ["k"], "t", "s", "e", 4).select("t", "n")) == [(0, 2), (5, 1), (5, 2), (9, 1), (9, 2), (10, 2)]
    assert rows(align.first_interval(p, i, ["k"], "t", "s", "e", "n", 4).select("t", "n").filter("n is not null")) == [(0, 2), (5, 1), (9, 1), (10, 2)]


def test_confidence_merge_latest_of_equals_and_nan(spark):
    nan = float("nan")
    data = [(1, 0, 0.5, "a"), (1, 1, 0.9, "b"), (1, 2, 0.9, "c"), (2, 0, nan, "d"), (2, 1, 0.9, "e"), (3, 0, 0.1, "f"), (3, 1, nan, "g")]
    df = spark.createDataFrame(data, "frame int, o int, conf double, name string")
    assert rows(align.best_by_confidence(df, ["frame"], "conf", "o").select("frame", "name")) == [(1, "c"), (2, "d"), (3, "f")]


def test_results_replace_columns_and_the_first_counts(spark):
    f = spark.createDataFrame([(0, "old"), (1, "old")], "frame_index int, x string")
    r = spark.createDataFrame([(0, "a", 1), (0, "b", 2)], "frame_index int, y string, n int")
    assert rows(align.with_results(f, r, ["frame_index"], ["n"], {"y": "x"}).select("frame_index", "x")) == [(0, "a"), (1, None)]
    assert align.suffixed(f, r.withColumnRenamed("y", "x"), ["frame_index"]).columns == ["frame_index", "x", "x_kpts", "n"]


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_rows_without_a_time_have_no_neighbours(spark, direction):
    l = spark.createDataFrame([("a", None, 1), ("a", 10, 2), ("a", 10, 2)], "k string, t long, id int")
    r = spark.createDataFrame([("a", 10, 5), ("a", 12, 6)], "k string, t long, v int")
    for bucket in (None, 5):
        got = sorted((x["id"], x["r_v"]) for x in align.asof(l, r, ["k"], "t", direction, bucket=bucket).select("id", "r_v").collect())
        assert got == [(1, None), (2, 5), (2, 5)]


def test_repeated_rows_stay_apart(spark):
    t = spark.createDataFrame([("a", 10, {"x": 1}), ("a", 10, {"x": 1}), ("a", None, None)], "k string, t long, m map<string,int>")
    o = spark.createDataFrame([("a", 11), ("a", 12)], "k string, t long")
    assert sorted((r["t"] or -1, r["hits"], r["nearest"]) for r in align.hits(t, o, ["k"], "t", 0, 5, "k").collect()) == [(-1, 0, None), (10, 2, 1), (10, 2, 1)]
    i = spark.createDataFrame([("a", 1, 5, 20)], "k string, n int, s long, e long")
    assert sorted((r["t"] or -1, r["n"] or -1) for r in align.first_interval(t, i, ["k"], "t", "s", "e", "n", 4).collect()) == [(-1, -1), (10, 1), (10, 1)]
    s = spark.createDataFrame([("a", 1, 0, 9), ("a", 1, 0, 9), ("a", 2, None, 9), ("a", 3, 9, 0)], "k string, id int, s long, e long")
    p = spark.createDataFrame([("a", 7, 5, 9)], "k string, n int, s long, e long")
    assert sorted((r["id"], r["proposal"] or -1) for r in align.best_overlap(s, p, ["k"], "id", "s", "e", "n", 4).collect()) == [(1, 7), (1, 7), (2, -1), (3, -1)]
    n = spark.createDataFrame([("red bolt",), ("red bolt",), (None,)], "name string")
    k = spark.createDataFrame([("red",), ("red b",)], "key string")
    assert sorted((r["name"] or "", r["match"] or "") for r in align.longest_prefix(n, k, "name", "key", [3, 5]).collect()) == [("", ""), ("red bolt", "red b"), ("red bolt", "red b")]


def test_a_key_of_several_owners_is_ambiguous(spark):
    n = spark.createDataFrame([("Red_bolt_1",), ("blue_2",), ("green",)], "name string")
    k = spark.createDataFrame([("red", "p1"), ("RED_bolt", "p2"), ("red_bolt", "p3"), ("Blue", "p4")], "key string, project string")
    got = {r["name"]: (r["project"], r["ambiguous"]) for r in align.owner_of(n, k, "name", "key", "project", [3, 4, 8]).collect()}
    assert got == {"Red_bolt_1": (None, True), "blue_2": ("p4", False), "green": (None, False)}
