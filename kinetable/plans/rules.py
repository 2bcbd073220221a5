"""Queries of the quality rules, of their registry and of workflows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.operators import quality, rollups
from kinetable.operators.longstreams import Stream, total
from kinetable.plans import workflow
from kinetable.plans.registry import DAY, events, numbered_events, query, read, rounded
from kinetable.sources.datasets import stored

_FOUND = "'{rule}' AS rule, {status} AS status, round({value}, 4) AS value"
_GRADED = "CASE WHEN {fail} THEN 'fail' WHEN {warn} THEN 'warn' ELSE 'pass' END"


def finding(df: DataFrame) -> DataFrame:
    return rounded(df.drop("message"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as what a probe of a video reports."""
    o = read(spark, sf_dir, "orders")
    start = (F.col("o_orderkey") % 90).cast("double")
    black, still = F.struct(start.alias("start"), (start + F.col("o_orderkey") % 7 / 4).alias("end")), F.struct(start.alias("start"), (start + F.col("o_totalprice") / 40_000).alias("end"))
    reason = F.when(F.col("o_custkey") % 7 == 0, "decoder_missing").when(F.col("o_custkey") % 7 == 1, "open_failed")
    return o.groupBy(F.col("o_custkey").alias("episode_id")).agg(F.first(reason).alias("reason"), F.count_if(F.col("o_orderstatus") == "P").alias("decode_errors"), F.lit(100.0).alias("duration"), F.collect_list(black).alias("black_ranges"), F.collect_list(still).alias("freeze_ranges"))


@query(f"""SELECT o_custkey AS episode_id, NULL::VARCHAR AS stream, {_FOUND.format(rule='video.decode_error', status="CASE WHEN o_custkey % 7 = 0 THEN 'error' WHEN o_custkey % 7 = 1 OR count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'fail' ELSE 'pass' END", value="count(*) FILTER (o_orderstatus = 'P')::DOUBLE")} FROM orders GROUP BY 1""")
def decode_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finding(quality.decode_error(probes(spark, sf_dir)))


@query(f"""WITH s AS (SELECT o_custkey, coalesce(sum(o_orderkey % 7 / 4.0::DOUBLE) FILTER (o_orderkey % 7 >= 2), 0) / 100 AS v FROM orders GROUP BY 1) SELECT o_custkey AS episode_id, NULL::VARCHAR AS stream, {_FOUND.format(rule='video.black_screen', status=_GRADED.format(fail='v >= 0.05', warn='v > 0'), value='v')} FROM s""")
def black_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finding(quality.black_screen(probes(spark, sf_dir)))


@query(f"""WITH s AS (SELECT o_custkey, max(o_orderkey % 90 + o_totalprice / 40000 - o_orderkey % 90) AS v FROM orders GROUP BY 1) SELECT o_custkey AS episode_id, NULL::VARCHAR AS stream, {_FOUND.format(rule='video.freeze', status=_GRADED.format(fail='v >= 10', warn='v >= 2'), value='v')} FROM s""")
def freezes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finding(quality.freeze(probes(spark, sf_dir)))


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of a label as arrays of a sensor: thousandths; every tenth one is short, every seventh has no pressure."""
    v = F.transform("embedding", lambda x: F.when(F.col("vec_id") % 7 == 0, F.lit(0.0)).otherwise(x.cast("double") * 1000))
    v = F.when(F.col("vec_id") % 10 == 0, F.slice(v, 1, 63)).otherwise(v)
    return read(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("episode_id"), F.lit("left").alias("stream"), F.col("vec_id").alias("frame_index"), v.alias("values"))


_MAPS = "m AS (SELECT label::VARCHAR AS episode_id, 'left' AS stream, vec_id, list_transform(CASE WHEN vec_id % 10 = 0 THEN embedding[1:63] ELSE embedding END, lambda x: CASE WHEN vec_id % 7 = 0 THEN 0 ELSE x::DOUBLE * 1000 END) AS v FROM embeddings)"


@query(f"WITH {_MAPS}, s AS (SELECT episode_id, stream, avg((len(v) <> 64)::INT) AS v FROM m GROUP BY ALL) SELECT episode_id, stream, {_FOUND.format(rule='glove.array_shape', status=_GRADED.format(fail='v > 0.01', warn='v > 0'), value='v')} FROM s")
def array_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finding(quality.array_shape(maps(spark, sf_dir), 64))


@query(f"WITH {_MAPS}, s AS (SELECT episode_id, stream, coalesce(sum(len(list_filter(v, lambda x: x > 0 AND x < 500))) / nullif(sum(len(list_filter(v, lambda x: x > 0)))::DOUBLE, 0), 0) AS v FROM m GROUP BY ALL) SELECT episode_id, stream, {_FOUND.format(rule='glove.gate_floor', status=_GRADED.format(fail='v > 0.05', warn='v > 0'), value='v')} FROM s")
def gate_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finding(quality.gate_floor(maps(spark, sf_dir)))


@query(f"WITH {_MAPS}, s AS (SELECT episode_id, stream, avg((len(list_filter(v, lambda x: x > 0)) > 0)::INT) AS v FROM m GROUP BY ALL) SELECT episode_id, stream, {_FOUND.format(rule='glove.no_contact', status=_GRADED.format(fail='false', warn='v <= 0'), value='v')} FROM s")
def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finding(quality.no_contact(maps(spark, sf_dir)))


@query(f"""WITH l AS (SELECT l_returnflag, l_orderkey // 25 AS a, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem), r AS (SELECT l_returnflag, a, count(*) AS n FROM l WHERE a <> 0 GROUP BY ALL), s AS (SELECT l_returnflag, coalesce(max(n) FILTER (n >= 40), 0)::DOUBLE AS v FROM l LEFT JOIN r USING (l_returnflag, a) GROUP BY 1)
SELECT l_returnflag AS episode_id, 'left' AS stream, {_FOUND.format(rule='glove.frozen_array', status=_GRADED.format(fail='v >= 300', warn='v >= 40'), value='v')} FROM s""")
def frozen_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three streams, one for each flag, which hold all rows."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    own = read(spark, sf_dir, "lineitem").select("l_returnflag", *order)
    numbered = Stream(own, ["l_returnflag"], order, quality.LONG).add(frame_index=total(F.lit(1))).df
    rows = numbered.select(F.col("l_returnflag").alias("episode_id"), F.lit("left").alias("stream"), "frame_index", F.array(F.floor(F.col("l_orderkey") / 25)).alias("values"))
    return finding(quality.frozen_array(stored(rows, "frames")))


_STATUS = "CASE WHEN user_id % 3 = 0 THEN 'connected' WHEN user_id % 3 = 1 AND event_type = 'signup' THEN '' WHEN user_id % 3 = 1 THEN 'connected' ELSE event_type END"


@query(f"""WITH e AS (SELECT user_id, event_id, {_STATUS} AS s FROM events), t AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM e), g AS (SELECT user_id, count(*) FILTER (s <> p)::DOUBLE AS v, count(DISTINCT CASE WHEN s <> '' THEN s END) AS d, count(*) FILTER (s = '') AS b, max(CASE WHEN s <> '' THEN s END) AS one FROM t GROUP BY 1)
SELECT user_id::VARCHAR AS episode_id, 'glove' AS stream, {_FOUND.format(rule='glove.device_status', status=_GRADED.format(fail='d > 1', warn="b > 0 OR one <> 'connected'"), value='v')} FROM g""")
def device_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("user_id") % 3
    status = F.when(k == 0, "connected").when((k == 1) & (F.col("event_type") == "signup"), "").when(k == 1, "connected").otherwise(F.col("event_type"))
    rows = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("episode_id"), F.lit("glove").alias("stream"), F.col("event_id").alias("frame_index"), status.alias("status"))
    return finding(quality.device_status(rows))


@query(f"""WITH e AS (SELECT user_id, event_id, event_type <> 'error' AS u, CASE WHEN user_id % 4 = 0 THEN 1.0 ELSE value END AS x, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), g AS (SELECT user_id, avg(u::INT) AS v, max(CASE WHEN u AND n <= 30 THEN x END) - min(CASE WHEN u AND n <= 30 THEN x END) AS d FROM e GROUP BY 1)
SELECT user_id::VARCHAR AS episode_id, 'action' AS stream, {_FOUND.format(rule='umi.action_present', status=_GRADED.format(fail='coalesce(d <= 1e-9, true)', warn='v < 0.95'), value='v')} FROM g""")
def actions_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("user_id") % 4 == 0, 1.0).otherwise(F.col("value"))
    values = F.when(F.col("event_type") != "error", F.array(x, F.lit(2.0))).otherwise(F.array().cast("array<double>"))
    rows = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("episode_id"), F.lit("action").alias("stream"), F.col("event_id").alias("frame_index"), values.alias("values"))
    return finding(quality.action_present(rows, first=30))


@query(f"""WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT user_id, min_by(n, event_type) AS r FROM n WHERE event_type IN ('view', 'click') GROUP BY 1), s AS (SELECT n.user_id, event_type, abs(n - r)::DOUBLE AS v FROM n JOIN r USING (user_id) WHERE event_type NOT IN ('view', 'click'))
SELECT user_id::VARCHAR AS episode_id, event_type AS stream, {_FOUND.format(rule='umi.av_sync', status=_GRADED.format(fail='v > 2', warn='false'), value='v')} FROM s""")
def av_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("episode_id"), F.col("event_type").alias("stream")).agg(F.count("*").alias("rows"))
    return finding(quality.av_sync(counts.withColumn("kind", F.when(F.col("stream").isin("view", "click"), "rgb").otherwise("imu"))))


@query(f"""WITH s AS (SELECT user_id, avg((event_type = 'error')::INT) AS v FROM events GROUP BY 1) SELECT user_id::VARCHAR AS episode_id, 'slam' AS stream, {_FOUND.format(rule='umi.slam_coverage', status=_GRADED.format(fail='v >= 0.1', warn='v >= 0.02'), value='v')} FROM s""")
def slam_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("episode_id"), F.lit("slam").alias("stream"), (F.col("event_type") == "error").alias("interpolated"))
    return finding(quality.slam_coverage(rows))


@query(f"""WITH e AS (SELECT label, sqrt(pow(embedding[1]::DOUBLE, 2) + pow(embedding[2]::DOUBLE, 2) + pow(embedding[3]::DOUBLE, 2)) * 5000 AS f, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings), s AS (SELECT label, abs(quantile_cont(CASE WHEN i > n // 2 THEN f END, 0.5) - quantile_cont(CASE WHEN i <= n // 2 THEN f END, 0.5)) AS v FROM e WHERE n >= 20 GROUP BY 1)
SELECT label::VARCHAR AS episode_id, 'force' AS stream, {_FOUND.format(rule='umi.force_baseline', status=_GRADED.format(fail='false', warn='v > 200'), value='v')} FROM s""")
def force_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double") * 5000)
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("episode_id"), F.lit("force").alias("stream"), F.col("vec_id").alias("frame_index"), v.alias("values"))
    return finding(quality.force_baseline(rows))


@query(f"""WITH e AS (SELECT user_id, epoch_us(ts) // {DAY} - 19723 AS f, value, event_type FROM events), g AS (SELECT user_id, count(DISTINCT f) AS frames, bool_or(value <> 0) FILTER (f < 10) AS active, bool_and(event_type <> 'signup' OR user_id % 2 = 0) AS connected FROM e GROUP BY 1), p AS (SELECT *, 27 + user_id % 6 AS video FROM g)
SELECT user_id AS episode_id, frames, coalesce(active, false) AS active, connected, abs(video - frames) <= 0.1 * greatest(video, frames) AS aligned, abs(video - frames) <= 0.1 * greatest(video, frames) AND coalesce(active, false) AND connected AND user_id % 5 <> 0 AS ok FROM p""")
def legacy_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    status = F.when((F.col("event_type") == "signup") & (F.col("user_id") % 2 != 0), "disconnected").otherwise("connected")
    rows = e.select(F.col("user_id").alias("episode_id"), (F.floor(F.col("us") / DAY) - 19723).alias("frame_index"), F.array("value").alias("values"), status.alias("status"))
    videos = e.select(F.col("user_id").alias("episode_id")).distinct().select("episode_id", (27 + F.col("episode_id") % 6).alias("frame_count"), (F.col("episode_id") % 5 != 0).alias("readable"))
    return quality.legacy_validation(rows, videos).select("episode_id", "frames", F.coalesce("active", F.lit(False)).alias("active"), "connected", "aligned", "ok")


_KINDS = [("mono_rgb", ("rgb", "time")), ("glove_sensor", ("tactile", "device_status", "imu", "time")), ("gripper_device", ("rgb", "slam", "gripper_state", "force", "action", "time"))]
_RULES = ", ".join(f"('{c.slug}', {list(c.channels)}::VARCHAR[], {list(c.modalities)}::VARCHAR[])" for c in quality.CHECKS.values())
_OWN = "e AS (SELECT c_custkey AS episode_id, CASE c_custkey % 3 " + " ".join(f"WHEN {i} THEN {list(v)}" for i, (_, v) in enumerate(_KINDS)) + " END AS channels, [CASE c_custkey % 3 " + " ".join(f"WHEN {i} THEN '{k}'" for i, (k, _) in enumerate(_KINDS)) + " END] AS modalities FROM customer)"


def equipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as episodes with the channels and modalities of three kinds of devices."""
    at = (F.col("c_custkey") % 3 + 1).cast("int")
    channels, kinds = F.array(*[F.array(*map(F.lit, v)) for _, v in _KINDS]), F.array(*[F.lit(k) for k, _ in _KINDS])
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("episode_id"), F.element_at(channels, at).alias("channels"), F.array(F.element_at(kinds, at)).alias("modalities"))


@query(f"WITH {_OWN}, r(slug, needs, cards) AS (VALUES {_RULES}) SELECT episode_id, slug FROM e JOIN r ON list_has_all(channels, needs) AND (len(cards) = 0 OR list_has_any(cards, modalities)) WHERE slug <> 'video.freeze'")
def applicable_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.applicable(equipped(spark, sf_dir), disabled=["video.freeze"])


@query(f"WITH {_OWN} SELECT episode_id, CASE WHEN episode_id % 2 = 0 THEN array_to_string(modalities, ',') WHEN episode_id % 3 = 0 THEN 'stereo_rgb,mono_rgb' ELSE 'stereo_rgb,' || modalities[1] END AS modalities, array_to_string(channels, ',') AS channels FROM e")
def inferred_modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = equipped(spark, sf_dir)
    hint = F.when(F.col("episode_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("stereo_rgb")))
    return e.select("episode_id", F.array_join(quality.inferred_modalities(F.col("channels"), hint), ",").alias("modalities"), F.array_join(quality.channels_for(F.col("modalities")), ",").alias("channels"))


@query(f"""WITH {_OWN}, r(slug, needs, cards) AS (VALUES {_RULES}), v(slug, name) AS (VALUES {", ".join(f"('{c.slug}', '{c.slug}@{c.version}')" for c in quality.CHECKS.values())}),
a AS (SELECT episode_id, name FROM e JOIN r ON list_has_all(channels, needs) AND (len(cards) = 0 OR list_has_any(cards, modalities)) JOIN v ON r.slug = v.slug)
SELECT episode_id, substr(sha256(string_agg(name, '|' ORDER BY name)), 1, 24) AS revision FROM a GROUP BY 1""")
def ruleset_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each episode the revision of the checks that apply to it, which tells when it has to be checked again."""
    return quality.revisions(quality.applicable(equipped(spark, sf_dir)))


@query(f"WITH {_MAPS}, s AS (SELECT episode_id, avg((len(v) <> 256)::INT) AS v FROM m GROUP BY ALL), c AS (SELECT 'glove.array_shape' AS rule, CASE WHEN v > 0.01 THEN 'fail' WHEN v > 0 THEN 'warn' ELSE 'pass' END AS status FROM s UNION ALL SELECT 'glove.no_contact', CASE WHEN max(len(list_filter(v, lambda x: x > 0))) > 0 THEN 'pass' ELSE 'warn' END FROM m GROUP BY episode_id UNION ALL SELECT 'glove.gate_floor', 'error') SELECT rule, status, count(*) AS n FROM c GROUP BY ALL")
def checks_with_a_failing_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = maps(spark, sf_dir)
    torn = m.withColumn("values", F.when(F.col("frame_index") >= 0, F.raise_error(F.lit("torn")).cast("array<double>")).otherwise(F.col("values")))
    found = quality.run_checks({"glove.array_shape": m, "glove.no_contact": m, "glove.gate_floor": torn})
    return found.groupBy("rule", "status").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.top_ranges(read(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query("SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE value > 40 AND event_type <> 'error' GROUP BY 1")
def workflow_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of nodes over the events: two filters between an input and a count, one node that has nothing to do."""

    def skip(inputs, config):
        raise workflow.Skip

    kinds = {
        "catalog_input": ("input", (), lambda i, c: {"out": i["given"]}),
        "catalog_above": ("process", ("frames",), lambda i, c: {"out": i["frames"].filter(F.col("value") > c["least"])}),
        "catalog_without": ("process", ("frames",), lambda i, c: {"out": i["frames"].filter(F.col("event_type") != c["kind"])}),
        "catalog_count": ("export", ("frames",), lambda i, c: {"out": i["frames"].groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))}),
        "catalog_idle": ("process", ("frames",), skip),
    }
    for name, (category, needs, run) in kinds.items():
        if name not in workflow.KINDS:
            workflow.node_kind(name, category, needs, least=0)(run)
    nodes = [workflow.Node("n", "catalog_count"), workflow.Node("a", "catalog_above", {"least": 10}), workflow.Node("w", "catalog_without", {"kind": "error"}), workflow.Node("i", "catalog_input"), workflow.Node("x", "catalog_idle")]
    edges = [workflow.Edge(*e) for e in (("i", "out", "a", "frames"), ("a", "out", "w", "frames"), ("w", "out", "n", "frames"), ("i", "out", "x", "frames"))]
    made, state = workflow.execute(nodes, edges, {"i": read(spark, sf_dir, "events")}, {"a": {"least": 40}})
    assert state["x"] == "skipped" and workflow.upstream("n", nodes, edges) == ["i"]
    return made["n", "out"]


@query("SELECT c_custkey AS episode_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus IN ('F', 'O'))")
def runs_to_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.create_map(*map(F.lit, ("F", "completed", "O", "queued", "P", "failed"))), F.col("o_orderstatus"))
    runs = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("episode_id"), F.col("o_orderpriority").alias("revision"), status.alias("status"))
    return workflow.to_run(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("episode_id")), runs, "1-URGENT")


_REFS = {"orders": "o_orderpriority", "customer": "c_mktsegment"}


@query("""SELECT 'orders' AS store, count(*) FILTER (o_orderpriority = 'BUILDING') AS changed, count(*) FILTER (o_orderpriority = 'renamed') AS already, count(*) AS "rows" FROM orders UNION ALL SELECT 'customer', count(*) FILTER (c_mktsegment = 'BUILDING'), count(*) FILTER (c_mktsegment = 'renamed'), count(*) FROM customer""")
def renamed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    stores = {n: (read(spark, sf_dir, n), c) for n, c in _REFS.items()}
    new, counts = rollups.renamed(stores, "BUILDING", "renamed")
    out = None
    for n, c in _REFS.items():
        own = new[n].agg(F.count_if(F.col(c) == "renamed").alias("n"), F.count_if(F.col(c) == "BUILDING").alias("left"), F.count("*").alias("rows")).withColumn("store", F.lit(n))
        out = own if out is None else out.unionByName(own)
    return counts.join(out.filter("`left` = 0"), "store").select("store", "changed", (F.col("n") - F.col("changed")).alias("already"), "rows")


@query("""WITH x AS (SELECT o_custkey AS e, o_orderkey AS id, o_orderkey % 50 AS s, o_orderkey % 50 + o_orderkey % 7 - 1 AS z, CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE o_orderstatus END AS label FROM orders), old AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY id) - 1 AS n FROM x WHERE id % 3 = 0), new AS (SELECT x.* FROM x ANTI JOIN old ON x.e = old.e AND x.id = old.id WHERE trim(x.label) <> '' AND x.z > x.s), m AS (SELECT e, max(n) AS m FROM old GROUP BY 1)
SELECT new.e AS episode, id, (coalesce(m, -1) + row_number() OVER (PARTITION BY new.e ORDER BY s, z, id))::BIGINT AS sort_order FROM new LEFT JOIN m USING (e)""")
def imported_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third segment is there already; the import brings all of them."""
    from pyspark.sql import Window

    label = F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus"))
    start = F.col("o_orderkey") % 50
    every = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("episode"), F.col("o_orderkey").alias("id"), start.alias("start_frame"), (start + F.col("o_orderkey") % 7 - 1).alias("end_frame"), label.alias("label"))
    old = every.join(every.filter("id % 3 = 0").select("id"), "id", "left_semi").withColumn("sort_order", F.row_number().over(Window.partitionBy("episode").orderBy("id")) - 1)
    return rounded(rollups.imported_actions(old, every, ["episode"]).select("episode", "id", "sort_order"))
