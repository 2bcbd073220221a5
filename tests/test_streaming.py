import pytest
from pyspark.sql import functions as F

from kinetable.operators import tracks
from kinetable.streaming import incremental as S

SCHEMA = "device string, session string, amount long, ts timestamp"


@pytest.fixture
def feed(spark, tmp_path):
    def put(n, rows, schema=SCHEMA):
        df = spark.createDataFrame(rows, schema.replace("timestamp", "string"))
        if "ts timestamp" in schema:
            df = df.withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        return f"{tmp_path}/in/*"

    return put


def collected(spark, df, tmp_path, mode="append"):
    df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.table("out")


def test_replayed_increments_count_once(spark, feed, tmp_path):
    rows = [("a", "s1", 3, "2024-01-01 00:00:00"), ("a", "s2", 2, "2024-01-01 00:01:00"), ("b", "s1", 1, "2024-01-01 00:02:00")]
    feed(1, rows)
    path = feed(2, [*rows, ("a", "s3", 1, "2024-01-01 00:03:00")])
    once = S.ledger(S.source(spark, path, SCHEMA, files=1), ["device"], "session", "ts")
    got = collected(spark, once, tmp_path).groupBy("device").agg(F.sum("amount").alias("n"))
    assert {r["device"]: r["n"] for r in got.collect()} == {"a": 6, "b": 1}


def test_running_statistics_survive_a_replay(spark, feed, tmp_path):
    feed(1, [("a", "s", x, "2024-01-01 00:00:00") for x in (1, 2, 3)])
    path = feed(2, [("a", "s", x, "2024-01-01 00:00:00") for x in (4, 5)])
    for _ in range(2):
        S.running_stats(S.source(spark, path, SCHEMA, files=1), ["device"], "amount", f"{tmp_path}/stats", f"{tmp_path}/cp").awaitTermination()
    r = S.whole_stats(spark, f"{tmp_path}/stats", ["device"]).first()
    assert (r["n"], r["total"], r["low"], r["high"]) == (5, 15.0, 1.0, 5.0)


def test_sessions_and_days(spark, feed, tmp_path):
    times = ["00:00:00", "00:00:30", "00:01:00", "00:10:00"]
    path = feed(1, [("a", "s", 1, f"2024-01-01 {t}") for t in times] + [("z", "s", 1, "2024-01-09 00:00:00")])
    feed(2, [("z", "s", 1, "2024-01-20 00:00:00")])
    got = collected(spark, S.sessions(S.source(spark, path, SCHEMA, files=1), ["device"], "ts", "1 minute", "1 hour"), tmp_path)
    assert sorted(r["n"] for r in got.filter("device = 'a'").collect()) == [1, 3]


def test_late_samples_are_accounted_for(spark, feed, tmp_path):
    path = feed(1, [("a", "s", 1, f"2024-01-0{d} 00:00:00") for d in (1, 2, 3, 9)])
    S.accounted(S.source(spark, path, SCHEMA), "ts", "2024-01-02", "2024-01-05", f"{tmp_path}/o", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/o/kept").count() == 2 and spark.read.parquet(f"{tmp_path}/o/dropped").agg(F.sum("dropped")).first()[0] == 2


def test_the_streaming_filter_equals_the_batch_one(spark, feed, tmp_path):
    schema = "k string, t double, x double"
    rows = [("a", i / 30, float((i * 7) % 5)) for i in range(40)]
    feed(1, rows[:15], schema)
    path = feed(2, rows[15:], schema)
    got = collected(spark, S.smoothing(S.source(spark, path, schema, files=1), "k", "t", "x"), tmp_path)
    want = tracks.one_euro(spark.createDataFrame(rows, schema), ["k"], "t", "x")
    a, b = ({r["t"]: r["smooth"] for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys() and all(abs(a[t] - b[t]) < 1e-9 for t in a)


def test_a_ledger_never_forgets(spark, feed, tmp_path):
    rows = [("a", "s1", 3, "2024-01-01 00:00:00"), ("a", None, 2, "2024-01-01 00:01:00")]
    feed(1, rows)
    feed(2, [("b", "s9", 5, "2024-06-01 00:00:00")])
    path = feed(3, [*rows, ("a", "s3", 1, "2024-06-02 00:00:00")])
    for _ in range(2):
        S.recorded(S.source(spark, path, SCHEMA, files=1), ["device"], "session", f"{tmp_path}/ledger", f"{tmp_path}/cp").awaitTermination()
    got = S.totals(spark.read.parquet(f"{tmp_path}/ledger"), ["device"], "amount")
    assert {r["device"]: r["total"] for r in got.collect()} == {"a": 6, "b": 5}


def test_samples_without_a_time_are_accounted_for(spark, feed, tmp_path):
    path = feed(1, [("a", "s", 1, "2024-01-03 00:00:00"), ("a", "s", 1, None)])
    S.accounted(S.source(spark, path, SCHEMA), "ts", "2024-01-02", "2024-01-05", f"{tmp_path}/o", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/o/kept").count() == 1 and spark.read.parquet(f"{tmp_path}/o/dropped").agg(F.sum("dropped")).first()[0] == 1


def test_the_streaming_filter_skips_what_is_missing(spark, feed, tmp_path):
    schema = "k string, t double, x double"
    rows = [("a", i / 30, None if i % 7 == 3 else float("nan") if i % 7 == 5 else float((i * 7) % 5)) for i in range(40)]
    feed(1, rows[:15], schema)
    path = feed(2, rows[15:], schema)
    got = collected(spark, S.smoothing(S.source(spark, path, schema, files=1), "k", "t", "x"), tmp_path)
    want = tracks.one_euro(spark.createDataFrame(rows, schema), ["k"], "t", "x")
    a, b = ({r["t"]: r["smooth"] for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys() and all((a[t] is None) == (b[t] is None) and (a[t] is None or abs(a[t] - b[t]) < 1e-9) for t in a)


def test_streaming_gaps_equal_the_batch_ones(spark, feed, tmp_path):
    from kinetable.operators import clocks

    schema = "k string, i long, t double"
    rows = [("a", i, t) for i, t in enumerate([1.0, 2.0, 0.0, 7.0, 8.0, 3.0, 4.0, 20.0, 21.0, 21.5])]
    feed(1, rows[:5], schema)
    path = feed(2, rows[5:], schema)
    got = collected(spark, S.gap_watch(S.source(spark, path, schema, files=1), "k", "i", "t", 1.0, 2.0), tmp_path, "update")
    last = max(got.collect(), key=lambda r: r["readings"])
    want = clocks.gap_watch(spark.createDataFrame(rows, schema), ["k"], ["i"], "t", 1.0, 2.0).first()
    assert all(last[c] == want[c] for c in ("readings", "gaps", "lost", "peak", "resyncs"))
