"""Queries of column functions: names, channels, hands, joints, sources and nested values."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.functions import hands
from kinetable.functions import values as V
from kinetable.operators import assembly, rollups
from kinetable.plans.registry import events, query, read, rounded
from kinetable.plans.scalars import _V, vectors
from kinetable.sources import datasets
from kinetable.streaming import incremental


@query("SELECT vec_id, len(embedding)::BIGINT AS n, label::BIGINT AS label FROM embeddings")
def aliased_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture-side name becomes ours; one whose own name is there stays."""
    df = read(spark, sf_dir, "embeddings").withColumnsRenamed({"embedding": "observation.tactile.left", "label": "observation.right_glove"})
    own = assembly.with_aliases(df.withColumn("observation.tactile.right", F.lit(0)), datasets.ALIASES)
    return own.select("vec_id", F.size("`observation.left_glove`").cast("long").alias("n"), F.col("`observation.right_glove`").cast("long").alias("label"))


@query(f"WITH {_V} SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 0 ELSE 7 END::BIGINT AS n, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE round(list_sum(e[1:7]), 5) END AS total FROM v")
def fitted_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = V.fitted(F.when(F.col("vec_id") % 5 != 0, F.col("e")), 7)
    total = F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda s, x: s + x))
    return rounded(vectors(spark, sf_dir).select("vec_id", F.size(own).cast("long").alias("n"), total.alias("total")), 5)


_JOINTS = 5


@query(f"""WITH {_V}, j AS (SELECT vec_id, i, list_transform(range(1, 4), lambda k: e[3 * i + k] - e[3 * (i + 1) + k]) AS p, list_transform(range(1, 4), lambda k: e[3 * (i + 2) + k] - e[3 * (i + 1) + k]) AS q FROM v, range({_JOINTS}) AS t(i)),
a AS (SELECT vec_id, i, degrees(acos(greatest(-1, least(1, list_dot_product(p, q) / sqrt(list_dot_product(p, p) * list_dot_product(q, q)))))) AS deg FROM j)
SELECT vec_id, round(max(CASE WHEN i = 0 THEN deg END), 4) AS first, sum(CASE WHEN deg >= 90 THEN 1 << i ELSE 0 END)::BIGINT AS mask FROM a GROUP BY 1""")
def stretched_joints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles of joints, and which of them are stretched, as bits."""
    point = lambda i: F.slice("e", 3 * i + 1, 3)
    angles = [V.joint_angle(point(i), point(i + 1), point(i + 2)) for i in range(_JOINTS)]
    return rounded(vectors(spark, sf_dir).select("vec_id", angles[0].alias("first"), V.extension_mask(angles, 90.0).cast("long").alias("mask")))


@query(f"WITH {_V} SELECT vec_id, CASE WHEN e[3] > 0 THEN round((e[1] * 100 - 320) * e[3] / 600, 5) END AS x, CASE WHEN e[3] > 0 THEN round((e[2] * 100 - 240) * e[3] / 600, 5) END AS y FROM v")
def back_projected_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("e")
    own = V.back_projected(e[0] * 100, e[1] * 100, e[2], 600.0, 600.0, 320.0, 240.0)
    return rounded(vectors(spark, sf_dir).select("vec_id", own[0].alias("x"), own[1].alias("y")), 5)


@query("""WITH n AS (SELECT count(*) AS n, count(label) AS l FROM embeddings) SELECT unnest(['observation.glove_hand_left_keypoints_cam', 'observation.glove_hand_left_confidence_cam', 'observation.glove_hand_left_gesture_cam', 'observation.glove_hand_left_handedness_cam', 'observation.glove_hand_left_source_cam']) AS name, unnest([n, n, l, n, n]) AS there FROM n""")
def hand_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a hand under the names they are exported by, and how many rows have each."""
    values = {"keypoints": F.col("embedding"), "confidence": F.col("vec_id"), "gesture": F.col("label"), "handedness": F.lit("left"), "source": F.lit("glove")}
    names = hands.columns_of("glove_", "left", "_cam")
    own = read(spark, sf_dir, "embeddings").select(*[values[k].alias(n) for k, n in names.items()])
    counts = own.agg(*[F.count(f"`{n}`").alias(n) for n in names.values()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("there")) for n in names.values()])).alias("c")).select("c.*")


@query("SELECT label::BIGINT - 2 AS number, CASE label - 2 WHEN 0 THEN 'fist' WHEN 1 THEN 'open' WHEN 2 THEN 'point' WHEN 3 THEN 'victory' WHEN 4 THEN 'thumb_up' WHEN 5 THEN 'ok' ELSE '' END AS gesture, count(*) AS n FROM embeddings GROUP BY ALL")
def gesture_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("label").cast("long") - 2
    return read(spark, sf_dir, "embeddings").groupBy(number.alias("number"), hands.gesture(number).alias("gesture")).agg(F.count("*").alias("n"))


@query(f"""WITH {_V}, p AS (SELECT vec_id, unnest(range(0, 21)) AS point, e FROM v WHERE vec_id BETWEEN 20 AND 220 AND vec_id % 3 <> 0) SELECT vec_id, point, round_even(e[point * 3 + 1], 4) AS x, round_even(e[point * 3 + 2], 4) AS y FROM p""")
def frames_with_a_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a range of frames, without the frames that have no hand."""
    flat = F.slice("e", 1, 63)
    own = vectors(spark, sf_dir).filter(F.col("vec_id").between(20, 220) & hands.is_hand(flat, F.col("vec_id") % 3 != 0))
    points = own.select("vec_id", F.posexplode(hands.points(flat, digits=4)).alias("point", "p"))
    return points.select("vec_id", F.col("point").cast("long").alias("point"), F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@query("SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN value WHEN event_id % 3 = 1 THEN event_id END, 4) AS first, round(least(greatest(value * 2 - 50, 0), 100), 4) AS percent FROM events")
def usable_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of alternative columns that has a number, and a percentage within its bounds."""
    i, none = F.col("event_id"), F.lit(None).cast("double")
    a = F.when(i % 3 == 0, F.col("value")).when(i % 3 == 1, float("nan"))
    b = F.when(i % 3 == 1, i.cast("double")).when(i % 3 == 2, float("inf"))
    e = read(spark, sf_dir, "events")
    return rounded(e.select("event_id", V.first_finite(a, none, b).alias("first"), V.percent(F.col("value") * 2 - 50).alias("percent")))


@query("""WITH t AS (SELECT DISTINCT event_type AS t FROM events) SELECT 'observation.images.' || t || '-cam_rgb' AS name, upper(t) || '_cam.mp4' AS "match" FROM t""")
def matched_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources under two ways of writing them, by the variants of their names."""
    e = read(spark, sf_dir, "events").select("event_type")
    a = e.select(F.concat(F.lit("observation.images."), F.col("event_type"), F.lit("-cam_rgb")).alias("a"))
    return rollups.matched_sources(a, e.select(F.concat(F.upper("event_type"), F.lit("_cam.mp4")).alias("b")), "a", "b")


@query("""SELECT c.conv_id, count(*) AS turns, max(l.quality)::BIGINT AS quality, count(*) FILTER (length(text) > 200) AS exceptions, coalesce(string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) FILTER (length(text) > 200), '') AS at
FROM conversations c LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON c.conv_id = l.doc_id GROUP BY 1""")
def episode_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as episodes with their state, if any, and their exceptions as a list."""
    c = read(spark, sf_dir, "conversations")
    episodes = c.groupBy("conv_id").agg(F.count("*").alias("turns"))
    states = read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("conv_id")).agg(F.max("quality").cast("long").alias("quality"))
    long = c.filter(F.length("text") > 200).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("x"))
    out = episodes.join(states, "conv_id", "left").join(long, "conv_id", "left")
    x = F.coalesce("x", F.array().cast("array<bigint>"))
    return out.select("conv_id", "turns", "quality", F.size(x).cast("long").alias("exceptions"), F.array_join(x.cast("array<string>"), ",").alias("at"))


@query(f"WITH {_V}, c AS (SELECT vec_id, unnest(range(0, 4)) AS list, e FROM v), o AS (SELECT *, [0, 10, 10, 41, 64][list + 1] AS a, [0, 10, 10, 41, 64][list + 2] AS z FROM c) SELECT vec_id, list, z - a AS n, round(coalesce(list_sum(e[a + 1:z]), 0), 5) AS total FROM o")
def lists_from_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists from flat values and offsets, an empty one among them."""
    own = V.lists_of("e", F.array(*map(F.lit, (0, 10, 10, 41, 64))))
    rows = vectors(spark, sf_dir).select("vec_id", F.posexplode(own).alias("list", "x"))
    return rounded(rows.select("vec_id", F.col("list").cast("long").alias("list"), F.size("x").cast("long").alias("n"), F.aggregate("x", F.lit(0.0), lambda s, x: s + x).alias("total")), 5)


@query("SELECT event_id, 'keep,list' AS names, event_type AS kept FROM events")
def without_empty_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON values without what is empty or becomes so."""
    import json

    keep = F.concat(F.lit('{"keep":"'), F.col("event_type"), F.lit('","gone":{},"list":[1,[],{"x":{}}],"deep":{"x":{"y":[]}}}'))

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(j=[json.dumps(rollups.without_empty(json.loads(x))) for x in pdf["j"]])

    out = read(spark, sf_dir, "events").select("event_id", keep.alias("j")).mapInPandas(clean, "event_id long, j string")
    return out.select("event_id", F.array_join(F.array_sort(F.json_object_keys("j")), ",").alias("names"), F.get_json_object("j", "$.keep").alias("kept"))


@query("WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT unnest(['', 'left', 'right']) AS camera, unnest(['observation.slam_trajectory', 'observation.left_slam_pose', 'observation.right_slam_trajectory']) AS name, n AS rows FROM n")
def discovered_pose_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each camera its trajectory, or its pose where there is none, found by the names of columns."""
    e = read(spark, sf_dir, "embeddings")
    names = ("slam_pose", "slam_trajectory", "left_slam_pose", "right_slam_trajectory", "right_slam_pose", "slam_other")
    df = e.select(*[F.col("embedding").alias(f"observation.{n}") for n in names])
    found = assembly.pose_columns(df.columns)
    counts = df.agg(*[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(found.values())])
    rows = [F.struct(F.lit(camera).alias("camera"), F.lit(c).alias("name"), F.col(f"n{i}").alias("rows")) for i, (camera, c) in enumerate(found.items())]
    return counts.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


@query("SELECT user_id, count(*) AS rows, round(sum(value), 2) AS total FROM events GROUP BY 1")
def streamed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come as files of a stream, appended to a table once each."""
    own = datasets.scratch(spark, "frames")
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "value")
    e.repartition(5).write.parquet(f"{own}/in")
    for _ in range(2):  # the second run finds nothing new
        incremental.appended(incremental.source(spark, f"{own}/in", e.schema, files=2), f"{own}/out", f"{own}/checkpoint").awaitTermination()
    return rounded(spark.read.parquet(f"{own}/out").groupBy("user_id").agg(F.count("*").alias("rows"), F.sum("value").alias("total")), 2)


@query("SELECT user_id, md5(string_agg(DISTINCT event_type, ',' ORDER BY event_type)) AS fingerprint FROM events GROUP BY 1")
def set_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint of each user's set of types, whatever their order and number."""
    e = events(spark, sf_dir)
    return e.groupBy("user_id").agg(F.md5(F.array_join(F.array_sort(F.collect_set("event_type")), ",").cast("binary")).alias("fingerprint"))
