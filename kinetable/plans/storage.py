"""Queries that write datasets, logs and streams to scratch folders and read them back."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetable.functions import values as V
from kinetable.plans.registry import DAY, events, numbered_events, query, read, rounded
from kinetable.sources import datasets, logs, parts
from kinetable.streaming import incremental

_TURNS = "c AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as episodes, turns as frames."""
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("episode_index"), F.col("turn").alias("frame_index"), "role", F.length("text").cast("long").alias("n"))


@query(f"WITH {_TURNS} SELECT conv_id AS episode_index, count(*) AS \"rows\", sum(n)::BIGINT AS n, conv_id // 1000 AS chunk FROM c WHERE turn < 3 GROUP BY 1")
def dataset_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames written by chunk, in order of episodes, and read back by column and condition."""
    root = datasets.scratch(spark, "dataset")
    datasets.write_chunked(frames(spark, sf_dir), f"{root}/data")
    back = spark.read.parquet(f"{root}/data").filter("frame_index < 3")
    return back.groupBy("episode_index").agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.first("chunk").cast("long").alias("chunk")).withColumn("episode_index", F.col("episode_index").cast("long"))


@query(f"WITH {_TURNS} SELECT conv_id % 2 AS part, count(*) AS frames, count(role) FILTER (conv_id % 2 = 0) AS roles, sum(n)::BIGINT AS n FROM c GROUP BY 1")
def files_of_other_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one dataset of which some lack a column, and a column that none has."""
    root = datasets.scratch(spark, "mixed")
    f = frames(spark, sf_dir)
    f.filter("episode_index % 2 = 0").write.parquet(f"{root}/data/a")
    f.filter("episode_index % 2 = 1").drop("role").write.parquet(f"{root}/data/b")
    back = datasets.read_frames(spark, root, columns=["episode_index", "role", "n", "none"])
    assert back.filter("none is not null").isEmpty()
    return back.groupBy((F.col("episode_index") % 2).alias("part")).agg(F.count("*").alias("frames"), F.count("role").alias("roles"), F.sum("n").alias("n"))


@query("SELECT n_nationkey::BIGINT AS episode_index, 1::BIGINT AS videos, true AS has_data FROM nation")
def file_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the number in their names, one pair for each nation."""
    root = datasets.scratch(spark, "files")
    for r in read(spark, sf_dir, "nation").select("n_nationkey").toLocalIterator():
        datasets.write_text(spark, f"{root}/data/episode_{r[0]:06d}.parquet", "data")
        datasets.write_text(spark, f"{root}/videos/episode_{r[0]:06d}.mp4", "video")
    found = datasets.file_index(spark, root)
    return found.select("episode_index", F.size("videos").cast("long").alias("videos"), F.col("data").isNotNull().alias("has_data"))


@query("""WITH r AS (SELECT o_custkey AS episode_index, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT c_custkey AS episode_index, c_custkey % 25 AS length FROM customer) SELECT coalesce(r.episode_index, m.episode_index) AS episode_index, CASE WHEN n IS NULL THEN 'no frames' WHEN length IS NULL THEN 'no episode' ELSE 'length differs' END AS problem FROM r FULL JOIN m ON r.episode_index = m.episode_index WHERE n IS NULL OR length IS NULL OR n <> length""")
def verified_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("episode_index"))
    meta = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("episode_index"), (F.col("c_custkey") % 25).alias("length"))
    return datasets.verified(rows, meta).select("episode_index", "problem")


@query(f"WITH {_TURNS} SELECT conv_id AS episode_index, max(turn) AS last, CASE WHEN conv_id % 2 = 0 THEN '{{}}' ELSE 'h264' END AS video_codec, CASE WHEN conv_id % 2 = 0 THEN 0 ELSE 1.5 END::DOUBLE AS duration_sec FROM c GROUP BY 1")
def appended_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episode rows without some of their columns, which take defaults."""
    e = frames(spark, sf_dir).groupBy("episode_index").agg(F.max("frame_index").alias("last"))
    full = e.filter("episode_index % 2 = 1").withColumn("video_codec", F.lit("h264")).withColumn("duration_sec", F.lit(1.5))
    return datasets.appended(full, e.filter("episode_index % 2 = 0")).select("episode_index", "last", "video_codec", "duration_sec")


@query(f"WITH {_TURNS}, l AS (SELECT conv_id, max(turn) + 1 AS length FROM c GROUP BY 1), f AS (SELECT conv_id, unnest(range(0, length)) AS frame_index FROM l) SELECT f.conv_id AS episode_index, frame_index, round(frame_index / 30.0, 4) AS timestamp, role, n FROM f LEFT JOIN c ON c.conv_id = f.conv_id AND c.turn = frame_index")
def synthesized_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames made from lengths, with the columns that only another table has."""
    f = frames(spark, sf_dir)
    made = datasets.synthesized(f.groupBy("episode_index").agg((F.max("frame_index") + 1).alias("length")), 30.0)
    key = F.concat_ws(":", "episode_index", "frame_index").alias("key")
    out = datasets.merged_tables([made.select("*", key, F.lit(1).alias("one")), f.select("role", "n", key)], "key")
    return rounded(out.select("episode_index", "frame_index", F.col("timestamp").cast("double").alias("timestamp"), "role", "n"))


@query("SELECT user_id, bool_or(event_id % 5 = 0 AND value > 90) AS \"any\" FROM events GROUP BY 1")
def strided_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("v", F.array(F.when(F.col("value") > 90, 1).otherwise(0)))
    return datasets.strided_any(e, ["user_id"], "event_id", "v", 5)


@query("SELECT split, count(*) AS \"rows\", sum(o_orderkey)::BIGINT AS keys FROM (SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM orders) GROUP BY 1")
def split_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of a thousand rows in a folder for each split."""
    root = datasets.scratch(spark, "shards")
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "val").otherwise("train").alias("split"))
    datasets.write_shards(o, root, 1000)
    back = spark.read.parquet(root)
    assert back.groupBy(F.input_file_name()).count().filter("count > 1000").isEmpty()
    return back.groupBy("split").agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"))


@query("SELECT vec_id AS episode_index, unnest(range(0, 64)) AS position, round(unnest(embedding)::DOUBLE, 5) AS value FROM embeddings")
def ragged_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("episode_index"), F.lit(0).cast("long").alias("frame_index"), F.col("embedding").alias("value"))
    out = datasets.ragged(e, "value")
    return rounded(out.select("episode_index", F.col("_position").alias("position"), F.col("value").cast("double").alias("value")), 5)


@query("SELECT p_name AS task, row_number() OVER (ORDER BY min(p_partkey), p_name) - 1 AS task_index, (SELECT count(*) FROM part) AS total FROM part GROUP BY 1")
def meta_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions and tasks as JSON documents, put in place of an older dataset's as a whole."""
    from kinetable.operators import assembly

    root = datasets.scratch(spark, "meta")
    p = read(spark, sf_dir, "part")
    tasks = assembly.task_indexes(p, "p_name", "p_partkey").withColumnRenamed("p_name", "task")
    datasets.write_text(spark, f"{root}/live/meta/info.json", "{}")
    datasets.write_meta(spark, f"{root}/staged", {"total": p.count()}, tasks)
    datasets.swapped(spark, f"{root}/staged", f"{root}/live")
    info = datasets.read_json(spark, f"{root}/live/meta/info.json", "total bigint")
    return datasets.read_jsonl(spark, f"{root}/live/meta/tasks.jsonl", "task string, task_index bigint").crossJoin(F.broadcast(info))  # one row


@query(f"""WITH v AS (SELECT vec_id, unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT dim, round(avg(x), 4) AS mean, round(min(x), 4) AS "min", round(max(x), 4) AS "max", count(*) AS count, (SELECT count(*) FROM embeddings WHERE label % 2 = 0) AS even FROM v GROUP BY 1""")
def single_file_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames in one file, with the statistics beside it."""
    root = datasets.scratch(spark, "single")
    e = read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("episode_index"), F.col("vec_id").alias("frame_index"), "embedding")
    datasets.write_single(spark, e, f"{root}/data/file-000.parquet")
    back = spark.read.parquet(f"{root}/data/file-000.parquet")
    from kinetable.operators import stats

    datasets.write_stats(spark, root, stats.from_blocks(stats.vector_blocks(back, [], "embedding")), "embedding")
    told = datasets.read_stats(spark, root).filter("feature = 'embedding'")
    even = back.filter("episode_index % 2 = 0").agg(F.count("*").alias("even"))
    out = told.select(F.posexplode(F.arrays_zip("mean", "min", "max", "count")).alias("dim", "s")).select("dim", "s.*")
    return rounded(out.crossJoin(F.broadcast(even)))  # one row


@query("""WITH l AS (SELECT event_type, event_id, value FROM events WHERE event_id % 10 <> 7) SELECT CASE event_type WHEN 'error' THEN 'failure' WHEN 'view' THEN 'step' ELSE 'other' END AS kind, count(*) AS lines, count(*) FILTER (event_type = 'view') AS steps, round(sum(CASE WHEN event_type = 'view' THEN value END), 2) AS total FROM l GROUP BY 1""")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines and plain ones, some torn, with numbers in their messages."""
    root = datasets.scratch(spark, "logs")
    e = read(spark, sf_dir, "events")
    msg = F.when(F.col("event_type") == "error", F.lit("ERROR reading frame")).when(F.col("event_type") == "view", F.concat(F.lit("step "), F.format_string("%.2f", "value"), F.lit(" ms"))).otherwise(F.concat(F.lit("note "), "event_type"))
    line = F.when(F.col("event_id") % 10 == 7, F.lit('{"msg": "torn')).when(F.col("event_id") % 2 == 0, F.to_json(F.struct(msg.alias("msg"), F.lit(1.5).alias("ts")))).otherwise(msg)
    e.select(line.alias("value")).write.text(root)
    lines = logs.read_lines(spark, root).filter(~F.col("line").startswith('{"msg": "torn'))
    kinds = logs.line_classes(lines, {"failure": "^ERROR", "step": "^step "}).groupBy("kind").agg(F.sum("lines").alias("lines"))
    steps = logs.extracted(lines, r"^step ([0-9.]+) ms$", ["ms"]).agg(F.count("*").alias("n"), F.sum(F.col("ms").cast("double")).alias("s"))
    own = F.col("kind") == "step"
    return rounded(kinds.crossJoin(F.broadcast(steps)).select("kind", "lines", F.when(own, F.col("n")).otherwise(0).alias("steps"), F.when(own, F.col("s")).alias("total")), 2)


@query("""SELECT user_id, count(*) AS packets, sum(event_id)::BIGINT AS ids, sum(length(event_type))::BIGINT AS bytes FROM events GROUP BY 1""")
def packet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary packets of a header and a payload, a file for each user, with a torn packet at the end."""
    return _packets_of_users(spark, sf_dir, lambda root: logs.read_packets(spark, root, "<qI", ["id", "size"], "size"))


@query("""SELECT user_id, count(*) AS packets, sum(event_id)::BIGINT AS ids, sum(length(event_type))::BIGINT AS bytes FROM events GROUP BY 1""")
def cut_packet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files in byte ranges, which are entered wherever headers follow one another."""
    return _packets_of_users(spark, sf_dir, lambda root: parts.packets(spark, root, "<qI", ["id", "size"], "size", 1 << 12, lambda h: h["size"] < 100))


@query("SELECT count(*) AS whole FROM lineitem")
def sampled_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third row group of files with small ones, with weights that add up to the rows of all."""
    root = datasets.scratch(spark, "groups")
    read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag").write.option("parquet.block.size", 1 << 14).option("parquet.block.size.row.check.min", 100).parquet(root)
    found = parts.sampled_groups(spark, root, 3, ["l_returnflag"])
    return found.agg(F.rint(F.sum("weight")).cast("long").alias("whole"))


def _packets_of_users(spark: SparkSession, sf_dir: str, reader: Callable[[str], DataFrame]) -> DataFrame:
    root = datasets.scratch(spark, "packets")

    def save(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        body = b"".join(struct.pack("<qI", int(i), len(t)) + t.encode() for i, t in zip(pdf["event_id"], pdf["event_type"], strict=True))
        name = f"{base}/{key[0]}-{uuid.uuid4().hex}.bin"
        with store.open_output_stream(name) as out:
            out.write(body + struct.pack("<qI", 1, 99) + b"torn")
        return pd.DataFrame({"path": [f"{root}/{name.rsplit('/', 1)[1]}"]})

    paths = datasets.stored(read(spark, sf_dir, "events").groupBy("user_id").applyInPandas(save, "path string"), "manifest")  # what lost attempts leave is in no manifest
    found = reader(root)
    file = F.regexp_extract("path", r"([0-9]+-[0-9a-f]+)\.bin$", 1)
    own = found.withColumn("f", file).join(paths.select(file.alias("f")), "f", "left_semi")
    user = F.split("f", "-")[0].cast("long").alias("user_id")
    return own.groupBy(user).agg(F.count("*").alias("packets"), F.sum("id").alias("ids"), F.sum(F.length("payload")).cast("long").alias("bytes"))


@query("SELECT event_id, round(event_id / 30.0, 4) AS t, round(value, 2) AS x FROM events WHERE event_id % 100 <> 3")
def truth_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories as lines of eight numbers, with comments and torn lines."""
    root = datasets.scratch(spark, "truth")
    e = read(spark, sf_dir, "events")
    line = F.concat_ws(" ", F.format_string("%.6f", F.col("event_id") / 30), F.format_string("%.4f", "value"), F.lit("0 0 0 0 0"), F.lit("1"))
    e.select(F.when(F.col("event_id") % 100 == 3, F.lit("# a comment")).otherwise(line)).write.text(root)
    back = logs.read_truth(spark, root)
    return rounded(back.select(F.rint(F.col("t") * 30).cast("long").alias("event_id"), F.round("t", 4).alias("t"), F.round("x", 2).alias("x")))


@query("SELECT o_custkey, count(DISTINCT o_orderkey) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def replayed_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders sent twice, in batches: each counts once, however late it comes again."""
    own = datasets.scratch(spark, "ledger")
    o = read(spark, sf_dir, "orders")
    for part in (o, o.filter("o_orderkey % 3 = 0")):
        part.write.mode("append").parquet(f"{own}/in")
    stream = incremental.source(spark, f"{own}/in", o.schema, files=3)
    incremental.recorded(stream, ["o_custkey"], "o_orderkey", f"{own}/ledger", f"{own}/checkpoint").awaitTermination()
    return rounded(spark.read.parquet(f"{own}/ledger").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), 2)


@query(f"SELECT count(*) FILTER (epoch_us(ts) // {DAY} BETWEEN 19730 AND 19740) AS kept, count(*) FILTER (epoch_us(ts) // {DAY} NOT BETWEEN 19730 AND 19740) AS dropped FROM events")
def late_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples outside of a recording are left out and counted."""
    own = datasets.scratch(spark, "late")
    stream = incremental.source(spark, f"{sf_dir}/events.parquet*", read(spark, sf_dir, "events").schema).withColumn("day", F.floor(V.micros("ts") / DAY))
    incremental.accounted(stream, "day", 19730, 19740, f"{own}/out", f"{own}/checkpoint").awaitTermination()
    kept = spark.read.parquet(f"{own}/out/kept").agg(F.count("*").alias("kept"))
    return kept.crossJoin(F.broadcast(spark.read.parquet(f"{own}/out/dropped").agg(F.sum("dropped").alias("dropped"))))  # one row each


@query("""WITH s AS (SELECT user_id, ts, sum(CASE WHEN ts - p <= INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)) SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS start FROM s GROUP BY user_id, run""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events no more than six hours apart as one session; a last event far in the future lets all sessions end."""
    own = datasets.scratch(spark, "sessions")
    e = read(spark, sf_dir, "events").select("user_id", "ts")
    e.unionByName(e.limit(1).withColumn("ts", F.lit("2100-01-01 00:00:00").cast("timestamp_ntz")).withColumn("user_id", F.lit(-1).cast("long"))).write.parquet(f"{own}/in/a")
    e.limit(1).select(F.lit(-1).cast("long").alias("user_id"), F.lit("2100-02-01 00:00:00").cast("timestamp_ntz").alias("ts")).write.parquet(f"{own}/in/b")
    stream = incremental.source(spark, f"{own}/in/*", e.schema)
    found = incremental.sessions(stream, ["user_id"], "ts", "6 hours", "0 seconds")
    incremental.appended(found, f"{own}/out", f"{own}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{own}/out").filter("user_id >= 0").select("user_id", "n", F.unix_micros("start").alias("start"))


@query(f"""WITH s AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events), l AS (SELECT user_id, step, CASE WHEN step > 0 AND step - 21600000000 >= 3600000000 THEN step - 21600000000 END AS lost FROM s) SELECT user_id, count(*) AS readings, count(lost) AS gaps, coalesce(sum(lost), 0)::DOUBLE AS lost, count(*) FILTER (step < 0) AS resyncs FROM l GROUP BY 1""")
def stream_gap_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of each user's events, with the state kept from batch to batch: two halves of them, one after the other."""
    own = datasets.scratch(spark, "gaps")
    e = numbered_events(spark, sf_dir).select("user_id", "event_id", "frame", F.col("us").cast("double").alias("us"))
    half = F.count("*").over(Window.partitionBy("user_id")) / 2
    e.withColumn("part", (F.col("frame") > half).cast("int")).repartition("part", "user_id").write.partitionBy("part").parquet(f"{own}/in")
    previous = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (0, 1):  # the second run goes on from the first one's state
            spark.read.parquet(f"{own}/in/part={part}").write.mode("append").parquet(f"{own}/feed")
            stream = incremental.source(spark, f"{own}/feed", spark.read.parquet(f"{own}/feed").schema)
            found = incremental.gap_watch(stream, "user_id", "event_id", "us", 21_600_000_000.0, 3_600_000_000.0)
            incremental.started(found, f"{own}/checkpoint", lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{own}/out"), "update").awaitTermination()
    finally:
        if previous is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", previous)
    last = F.max_by(F.struct("readings", "gaps", "lost", "resyncs"), "readings")
    return spark.read.parquet(f"{own}/out").groupBy("user_id").agg(last.alias("s")).select("user_id", "s.*")


@query("SELECT c_mktsegment, n_name, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def scanned_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of all projects with their states, as tables of a database would be joined."""
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    own = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return own.groupBy("c_mktsegment", "n_name", "o_orderstatus").agg(F.count("*").alias("n"))
