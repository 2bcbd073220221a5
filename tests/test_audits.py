import math

from pyspark.sql import functions as F

from kinetable.functions import hands as H
from kinetable.functions import values as V
from kinetable.operators import audits as A
from kinetable.operators import stats


def test_offsets_find_a_shift_and_a_step(spark):
    ms = 1_000_000
    rows = [(n, i, i * 33 * ms + shift(i) * ms, i * 33 * ms) for n, shift in (("even", lambda i: 85), ("late", lambda i: 145), ("step", lambda i: 85 if i < 300 else 165)) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, i long, t long, ref long")
    out = {r["k"]: r for r in A.offsets(df, ["k"], "i", "t", "ref", 85.0 * ms).collect()}
    assert out["even"]["severity"] == "info" and out["late"]["severity"] == "warn" and out["late"]["median"] == 145 * ms
    assert out["step"]["severity"] in ("warn", "error") and out["step"]["step"] == 80 * ms and abs(out["even"]["drift_ppm"]) < 1e-6


def test_cross_counts_name_the_cause(spark):
    rows = [("e", "a", "dev", 61.0, 6100.0, 100.0), ("e", "b", "dev", 61.0, 5490.0, 90.0), ("e", "c", "dev", 61.0, 5800.0, 100.0), ("e", "d", "host", 61.0, 10.0, 100.0)]
    out = A.cross_counts(spark.createDataFrame(rows, "e string, stream string, clock string, rate double, samples double, span double"), ["e"])
    assert {r["stream"]: r["cause"] for r in out.collect()} == {"a": None, "b": "span", "c": "rate", "d": None}


def test_presence_and_sequences(spark):
    df = spark.createDataFrame([("e", [1], [1.0]), ("e", [], [1.0]), ("e", [1], None), ("e", None, None)], "e string, t array<int>, v array<double>")
    assert tuple(A.presence_mismatch(df, ["e"], "t", "v").first()) == ("e", 1, 1)
    seq = [(0, 0.0), (1, 33.0), (4, 132.0), (5, 200.0), (2, 210.0)]
    out = A.sequence_audit(spark.createDataFrame([("e", i, s, t) for i, (s, t) in enumerate(seq)], "e string, i int, s long, t double"), ["e"], "i", "s", "t", 33.0, 20.0).first()
    assert (out["back"], out["lost"], out["off_grid"]) == (1, 2, 1)


def test_completeness_and_hands(spark):
    nan = float("nan")
    whole = [[0.0, 0.0, 0.5]] * 21
    part = [[0.0, 0.0, 0.9]] + [[nan, 0.0, 0.0]] * 20
    df = spark.createDataFrame([("e", 0, whole), ("e", 1, part), ("e", 2, whole)], "e string, i int, p array<array<double>>")
    r = A.completeness(df, ["e"], "i", "p").first()
    assert (round(r["full"], 3), r["points"], r["flips"], r["wrist"]) == (0.667, 21.0, 2, 1.0)
    flat = [float(i) / 7 for i in range(63)]
    h = spark.createDataFrame([(flat, True, 1.0), ([*flat[:62], nan], True, nan), (flat[:10], True, -1.0), (flat, False, None)], "a array<double>, present boolean, g double")
    out = h.select(H.is_hand("a", "present").alias("ok"), H.points("a", digits=4).alias("p"), H.gesture("g").alias("g")).collect()
    assert [r["ok"] for r in out] == [True, False, False, False] and [r["g"] for r in out] == ["open", "", "", ""]
    assert out[0]["p"][1] == [0.4286, 0.5714, 0.7143] and out[1]["p"][20][2] is None and out[2]["p"] is None
    assert H.columns_of("rgb.", "left")["gesture"] == "observation.rgb.hand_left_gesture"


def test_lags_and_scales(spark):
    assert tuple(A.lag_peaks(spark.createDataFrame([("e", 5), ("e", -1), ("e", 9)], "e string, l int"), ["e"], "l").first()) == ("e", 9, 2)
    rows = [("x10", 1000.0 + i, 100.0 + i / 10) for i in range(10)] + [("one", 110.0, 100.0)] * 10 + [("odd", 500.0, 100.0)] * 10 + [("few", 100.0, 100.0)] * 2
    out = {r["k"]: r["scale"] for r in stats.scale_of(spark.createDataFrame(rows, "k string, t double, f double"), ["k"], "t", "f").collect()}
    assert out == {"x10": 10, "one": 1, "odd": None, "few": None}
    r = stats.display_range(spark.createDataFrame([("k", x) for x in (0.0, 1.0, 1.0, 1.1)], "k string, v double"), ["k"], "v").first()
    assert r["low"] == 1.0 and r["high"] == 1.5


def test_geometry(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0], [0.0, 2.0, 0.0], [0.0, 0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = df.select(V.angle_deg("a", "b"), V.angle_deg("a", "z"), V.joint_angle(F.col("a"), F.col("z"), F.col("b")), V.extension_mask([F.lit(170.0), F.lit(90.0), F.lit(165.0)]), V.back_projected(F.lit(420.0), F.lit(240.0), F.lit(2.0), 500.0, 500.0, 320.0, 240.0)).first()
    assert math.isclose(r[0], 90) and r[1] is None and math.isclose(r[2], 90) and r[3] == 5 and r[4] == [0.4, 0.0, 2.0]
