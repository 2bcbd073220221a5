"""Queries over ordered streams: filters, events, clocks and poses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetable.functions import hands, rotations
from kinetable.operators import align, assembly, audits, clocks, poses, quality, rollups, runs, tracks
from kinetable.plans.registry import DAY, HOUR, NUDGE, events, numbered_events, query, read, rounded

_E = "e AS (SELECT *, epoch_us(ts) AS us FROM events)"
#: Events numbered within their user's, without the values of errors.
_N = "e AS (SELECT user_id, event_type, value, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS frame FROM events), n AS (SELECT user_id, frame, us, CASE WHEN event_type <> 'error' THEN value END AS z FROM e)"


def values_without_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered_events(spark, sf_dir).withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))


def _weights(window: int) -> str:
    """The weights of Savitzky-Golay windows of 3 to ``window`` values as a list of matrices."""
    return "[" + ", ".join(str(tracks.savgol_weights(k).tolist()) for k in range(3, window + 1, 2)) + "]"


@query("""WITH c AS (SELECT l_orderkey, count(*) AS rows, md5(string_agg(l_linenumber || ':' || l_quantity, ',' ORDER BY l_linenumber, l_quantity)) AS content FROM lineitem GROUP BY 1)
SELECT l_orderkey, rows AS "rows", min(l_orderkey) OVER (PARTITION BY content) AS first_alike FROM c""")
def content_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of order lines by content: equal fingerprints for equal groups."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    out = assembly.fingerprint(lines, ["l_orderkey"], ["l_linenumber", "l_quantity"])
    first = out.groupBy("fingerprint").agg(F.min("l_orderkey").alias("first_alike"))
    return out.join(first, "fingerprint").select("l_orderkey", "rows", "first_alike")


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events WHERE isfinite(value)),
r(user_id, i, t, level, speed) AS (SELECT user_id, i, t, x, 0.0::DOUBLE FROM e WHERE i = 1 UNION ALL
  SELECT user_id, i, t, level + (x - level) / (1 + 1 / (2 * pi() * (1 + 0.007::DOUBLE * abs(speed)) * dt)), speed FROM (
    SELECT e.user_id, e.i, e.t, e.x, r.level, e.t - r.t AS dt, r.speed + ((e.x - r.level) / (e.t - r.t) - r.speed) / (1 + 1 / (2 * pi() * (e.t - r.t))) AS speed FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
SELECT user_id, t, round(level, 4) AS smooth FROM r UNION ALL SELECT user_id, epoch_us(ts) / 1e6, NULL FROM events WHERE NOT coalesce(isfinite(value), false)""")
def one_euro(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("user_id", (F.col("us") / 1e6).alias("t"), "value")
    out = tracks.one_euro(e, ["user_id"], "t", "value")
    return out.withColumn("smooth", F.round("smooth", 4))


@query(f"""WITH RECURSIVE {_N}, r(user_id, frame, place, speed, last, tracked, state) AS (SELECT user_id, frame, z, 0.0::DOUBLE, CASE WHEN z IS NOT NULL THEN frame END, z, CASE WHEN z IS NULL THEN 'absent' ELSE 'real' END FROM n WHERE frame = 1 UNION ALL
  SELECT user_id, frame, CASE WHEN z IS NULL THEN place WHEN fresh THEN z ELSE now END, CASE WHEN z IS NULL THEN speed WHEN fresh THEN 0 ELSE speed + 0.1::DOUBLE * ((now - place) / gap - speed) END, CASE WHEN z IS NULL THEN last ELSE frame END,
    CASE WHEN z IS NOT NULL THEN CASE WHEN fresh THEN z ELSE now END WHEN NOT fresh THEN place + speed * gap END, CASE WHEN z IS NOT NULL THEN 'real' WHEN fresh THEN 'absent' ELSE 'propagated' END FROM (
    SELECT n.user_id, n.frame, n.z, r.place, r.speed, r.last, n.frame - r.last AS gap, r.last IS NULL OR n.frame - r.last > 15 AS fresh, (r.place + r.speed * (n.frame - r.last)) + 0.5::DOUBLE * (n.z - r.place - r.speed * (n.frame - r.last)) AS now FROM r JOIN n ON n.user_id = r.user_id AND n.frame = r.frame + 1))
SELECT user_id, frame, round(tracked + {NUDGE}, 4) AS tracked, state FROM r""")
def alpha_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tracks.alpha_beta(values_without_errors(spark, sf_dir), ["user_id"], "frame", "value"), nudge=NUDGE)


_FORWARD = """SELECT user_id, frame, CASE WHEN z IS NULL THEN place WHEN fresh THEN z ELSE now END, CASE WHEN z IS NULL THEN speed WHEN fresh THEN 0 ELSE speed + 0.1::DOUBLE * ((now - place) / gap - speed) END, CASE WHEN z IS NULL THEN last ELSE frame END,
    CASE WHEN z IS NOT NULL THEN CASE WHEN fresh THEN z ELSE now END WHEN NOT fresh THEN place + speed * gap END FROM (
    SELECT n.user_id, n.frame, n.z, r.place, r.speed, r.last, abs(n.frame - r.last) AS gap, r.last IS NULL OR abs(n.frame - r.last) > 3 AS fresh, (r.place + r.speed * abs(n.frame - r.last)) + 0.5::DOUBLE * (n.z - r.place - r.speed * abs(n.frame - r.last)) AS now FROM {r} r JOIN m n ON n.user_id = r.user_id AND n.frame = r.frame {d} 1)"""


@query(f"""WITH RECURSIVE {_N}, m AS (SELECT user_id, frame, CASE WHEN frame % 11 > 4 THEN z END AS z FROM n), f(user_id, frame, place, speed, last, tracked) AS (SELECT user_id, frame, z, 0.0::DOUBLE, CASE WHEN z IS NOT NULL THEN frame END, z FROM m WHERE frame = 1 UNION ALL {_FORWARD.format(r='f', d='+')}),
b(user_id, frame, place, speed, last, tracked) AS (SELECT user_id, frame, z, 0.0::DOUBLE, CASE WHEN z IS NOT NULL THEN frame END, z FROM m JOIN (SELECT user_id, max(frame) AS frame FROM m GROUP BY 1) USING (user_id, frame) UNION ALL {_FORWARD.format(r='b', d='-')})
SELECT m.user_id, m.frame, round(coalesce(f.tracked, b.tracked) + {NUDGE}, 4) AS filled, CASE WHEN z IS NOT NULL THEN 'real' WHEN coalesce(f.tracked, b.tracked) IS NULL THEN 'absent' ELSE 'propagated' END AS state FROM m JOIN f USING (user_id, frame) JOIN b USING (user_id, frame)""")
def two_way_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = values_without_errors(spark, sf_dir).withColumn("value", F.when(F.col("frame") % 11 > 4, F.col("value")))
    return rounded(tracks.two_way_fill(e, ["user_id"], "frame", "value", max_lost=3), nudge=NUDGE)


@query(f"""WITH {_N}, s AS (SELECT *, lag(z) OVER w AS p, lead(z) OVER w AS q, max(CASE WHEN z IS NOT NULL THEN frame END) OVER (w ROWS UNBOUNDED PRECEDING) AS a, min(CASE WHEN z IS NOT NULL THEN frame END) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM n WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
k AS (SELECT s.user_id, s.frame, s.z, s.z IS NULL AND s.b - s.a - 1 <= 15 AS fits, list_filter([{{'x': s.a - 1, 'y': x.p}}, {{'x': s.a, 'y': x.z}}, {{'x': s.b, 'y': y.z}}, {{'x': s.b + 1, 'y': y.q}}], lambda c: c.y IS NOT NULL) AS c FROM s LEFT JOIN s x ON x.user_id = s.user_id AND x.frame = s.a LEFT JOIN s y ON y.user_id = s.user_id AND y.frame = s.b)
SELECT user_id, frame, round({NUDGE} + CASE WHEN fits THEN list_sum(list_transform(c, lambda u: u.y * coalesce(list_aggregate(list_transform(list_filter(c, lambda v: v.x <> u.x), lambda v: (frame - v.x) / (u.x - v.x)::DOUBLE), 'product'), 1))) ELSE z END, 4) AS filled, coalesce(fits, false) AS propagated FROM k""")
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tracks.fill_gaps(values_without_errors(spark, sf_dir), ["user_id"], "frame", "value"), nudge=NUDGE)


_SAVGOL = "CASE WHEN least({w}, n - 1 + n % 2) > 2 THEN list_inner_product(ys[s{w} + 1 : s{w} + least({w}, n - 1 + n % 2)], m{w}[(least({w}, n - 1 + n % 2) - 3) // 2 + 1][i - s{w} + 1]) ELSE y END"


@query(f"""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS frame, value AS y FROM events), l AS (SELECT user_id, list(y ORDER BY frame) AS ys, count(*) AS n, {_weights(7)}::DOUBLE[][][] AS m7, {_weights(21)}::DOUBLE[][][] AS m21 FROM e GROUP BY 1),
p AS (SELECT user_id, frame, frame - 1 AS i, y, ys, n, m7, m21, least(greatest(frame - 1 - least(7, n - 1 + n % 2) // 2, 0), n - least(7, n - 1 + n % 2)) AS s7, least(greatest(frame - 1 - least(21, n - 1 + n % 2) // 2, 0), n - least(21, n - 1 + n % 2)) AS s21 FROM e JOIN l USING (user_id)),
g AS (SELECT user_id, frame, i, n, y, {_SAVGOL.format(w=7)} AS a, {_SAVGOL.format(w=21)} AS b FROM p),
d AS (SELECT *, CASE WHEN n = 1 THEN 0 WHEN i = 0 THEN lead(a) OVER w - a WHEN i = n - 1 THEN a - lag(a) OVER w ELSE (lead(a) OVER w - lag(a) OVER w) / 2 END AS slope FROM g WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
s AS (SELECT *, least(greatest(abs(slope) * 30 / 0.05::DOUBLE, 0), 1) AS k FROM d) SELECT user_id, frame, round(CASE WHEN abs(k * a + (1 - k) * b - y) > 50 THEN a ELSE k * a + (1 - k) * b END, 4) AS smooth FROM s""")
def smooth_savgol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tracks.smoothed(numbered_events(spark, sf_dir), ["user_id"], "frame", "value", keep_jump=50.0))


_GRASPS = """g AS (SELECT user_id, frame * 40 AS f, CASE event_type WHEN 'click' THEN 'grasp' ELSE 'open' END AS k FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS frame FROM events) WHERE event_type IN ('click', 'view')), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f) AS i FROM g),
a(user_id, i, grp, f, k) AS (SELECT user_id, i, 0, f, k FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, a.grp + (o.f - a.f > 18)::INT, CASE WHEN o.f - a.f > 18 OR o.k <> a.k THEN o.f ELSE a.f END, CASE WHEN o.f - a.f > 18 OR o.k <> a.k THEN o.k ELSE a.k END FROM a JOIN o ON o.user_id = a.user_id AND o.i = a.i + 1),
m AS (SELECT user_id, max_by(f, i) AS f, max_by(k, i) AS k FROM a GROUP BY user_id, grp), c AS (SELECT *, sum(CASE WHEN k <> pk AND f - pf < 60 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY f) AS c FROM (SELECT *, lag(k) OVER (PARTITION BY user_id ORDER BY f) AS pk, lag(f) OVER (PARTITION BY user_id ORDER BY f) AS pf FROM m)),
d AS (SELECT user_id, f, k FROM (SELECT *, count(*) OVER (PARTITION BY user_id, c) AS n, row_number() OVER (PARTITION BY user_id, c ORDER BY f) AS p FROM c) WHERE p = n AND n % 2 = 1)"""


def grasp_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "grasp").when(F.col("event_type") == "view", "open")
    return numbered_events(spark, sf_dir).withColumn("kind", kind).filter("kind is not null").select("user_id", (F.col("frame") * 40).alias("frame"), "kind")


@query(f"WITH RECURSIVE {_GRASPS} SELECT user_id, f AS frame, k AS kind FROM d")
def debounce_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.debounced(grasp_events(spark, sf_dir), ["user_id"], "frame", "kind")


@query(f"""WITH RECURSIVE {_GRASPS}, t AS (SELECT user_id, max(f) + 100 AS total FROM g GROUP BY 1), p AS (SELECT user_id, f, k, total FROM d JOIN t USING (user_id) UNION ALL SELECT DISTINCT d.user_id, 0, NULL, total FROM d JOIN t USING (user_id)),
x AS (SELECT *, coalesce(lead(f) OVER (PARTITION BY user_id ORDER BY f) - 1, total - 1) AS z FROM p), y AS (SELECT *, z - f + 1 >= CASE WHEN total / 30.0 >= 600 THEN 150 ELSE 24 END AS long FROM x), q AS (SELECT *, coalesce(lag(long) OVER (PARTITION BY user_id ORDER BY f), true) AS joined FROM y),
u AS (SELECT *, sum((joined OR r = 1)::INT) OVER (PARTITION BY user_id ORDER BY f) AS seg FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f) AS r FROM q WHERE long)), v AS (SELECT user_id, seg, min(f) AS f, max(z) AS z, CASE list(k ORDER BY f)[1] WHEN 'grasp' THEN 'hold' WHEN 'open' THEN 'open_phase' ELSE 'phase' END AS label, max(total) - 1 AS last FROM u GROUP BY ALL),
w AS (SELECT user_id, seg, f, CASE WHEN seg = max(seg) OVER (PARTITION BY user_id) THEN greatest(z, last) ELSE z END AS z, label FROM v), h(user_id, fs, zs, ls) AS (SELECT user_id, list(f ORDER BY seg), list(z ORDER BY seg), list(label ORDER BY seg) FROM w GROUP BY 1 UNION ALL
  SELECT user_id, fs[1:j] || fs[j + 2:], zs[1:j - 1] || zs[j + 1:], ls[1:j] || ls[j + 2:] FROM (SELECT *, list_position(list_transform(range(1, len(fs)), lambda i: zs[i + 1] - fs[i]), list_min(list_transform(range(1, len(fs)), lambda i: zs[i + 1] - fs[i]))) AS j FROM h WHERE len(fs) > 12))
SELECT user_id, unnest(fs)::BIGINT AS start, unnest(zs)::BIGINT AS "end", unnest(ls) AS label FROM h WHERE len(fs) <= 12""")
def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = grasp_events(spark, sf_dir)
    total = e.groupBy("user_id").agg((F.max("frame") + 100).alias("total"))
    return tracks.event_segments(tracks.debounced(e, ["user_id"], "frame", "kind").join(total, "user_id"), ["user_id"], "frame", "kind", "total", most=12)


@query(f"""WITH {_N}, r AS (SELECT *, sum(CASE WHEN event_type = p THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY frame) AS run FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY frame) AS p FROM e)), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY frame) AS n FROM r)
SELECT user_id, frame, coalesce(last_value(CASE WHEN n >= 2 THEN event_type END IGNORE NULLS) OVER w, first_value(event_type) OVER w) AS stable FROM k WINDOW w AS (PARTITION BY user_id ORDER BY frame ROWS UNBOUNDED PRECEDING)""")
def label_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.hysteresis(numbered_events(spark, sf_dir), ["user_id"], "frame", "event_type", votes=2)


@query(f"""WITH RECURSIVE {_N}, r(user_id, frame, held, n, event) AS (SELECT user_id, frame, value * 10 >= 300 OR value >= 300, 0, CASE WHEN value * 10 >= 300 THEN 'triggered' END FROM e WHERE frame = 1 UNION ALL
  SELECT e.user_id, e.frame, CASE WHEN r.held THEN NOT (e.value < 20 AND r.n = 2) ELSE e.value * 10 >= 300 OR e.value >= 300 END, CASE WHEN r.held AND e.value < 20 AND r.n < 2 THEN r.n + 1 ELSE 0 END, CASE WHEN r.held AND e.value < 20 AND r.n = 2 THEN 'released' WHEN NOT r.held AND (e.value * 10 >= 300 OR e.value >= 300) THEN 'triggered' END FROM r JOIN e ON e.user_id = r.user_id AND e.frame = r.frame + 1)
SELECT user_id, frame, event FROM r WHERE event IS NOT NULL""")
def grip_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = numbered_events(spark, sf_dir).select("user_id", "frame", (F.col("value") * 10).alias("left"), F.col("value").alias("right"), F.col("value").alias("opening"))
    return tracks.grip_events(e, ["user_id"], "frame", "left", "right", "opening")


_V = "v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings)"
_UNIT = "u AS (SELECT *, e[4] / s AS x, e[5] / s AS y, e[6] / s AS z, e[7] / s AS w FROM (SELECT *, sqrt(e[4] * e[4] + e[5] * e[5] + e[6] * e[6] + e[7] * e[7]) AS s FROM v))"


def label_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of a label as a sequence of poses: their first seven values."""
    return read(spark, sf_dir, "embeddings").select("label", "vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 7).alias("pose"), (F.col("vec_id") % 100).alias("opening"))


@query(f"""WITH {_V}, {_UNIT}, n AS (SELECT *, lead(e[1]) OVER k - e[1] AS dx, lead(e[2]) OVER k - e[2] AS dy, lead(e[3]) OVER k - e[3] AS dz, lead(x) OVER k AS x2, lead(y) OVER k AS y2, lead(z) OVER k AS z2, lead(w) OVER k AS w2, (vec_id % 100) / 100.0::DOUBLE AS g FROM u WINDOW k AS (PARTITION BY label ORDER BY vec_id)),
c AS (SELECT *, y * dz - z * dy AS cx, z * dx - x * dz AS cy, x * dy - y * dx AS cz FROM n), r AS (SELECT label, vec_id, g, [dx - 2 * w * cx + 2 * (y * cz - z * cy), dy - 2 * w * cy + 2 * (z * cx - x * cz), dz - 2 * w * cz + 2 * (x * cy - y * cx)] AS t,
  w * x2 - x * w2 - y * z2 + z * y2 AS rx, w * y2 + x * z2 - y * w2 - z * x2 AS ry, w * z2 - x * y2 + y * x2 - z * w2 AS rz, w * w2 + x * x2 + y * y2 + z * z2 AS rw FROM c),
m AS (SELECT label, vec_id, g, CASE WHEN t[1] IS NOT NULL THEN t || list_transform([rx, ry, rz], lambda q: q * (CASE WHEN rw < 0 THEN -2 ELSE 2 END) * atan2(sqrt(rx * rx + ry * ry + rz * rz), abs(rw)) / sqrt(rx * rx + ry * ry + rz * rz)) END AS m FROM r),
f AS (SELECT label, vec_id, coalesce(m, lag(m) OVER k, [0.0, 0, 0, 0, 0, 0]) || [coalesce(lead(g) OVER k, g)] AS a FROM m WINDOW k AS (PARTITION BY label ORDER BY vec_id)) SELECT label::BIGINT AS label, vec_id, unnest(range(0, 7)) AS dim, round(unnest(a), 4) AS value FROM f""")
def pose_delta_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = poses.actions(label_poses(spark, sf_dir), ["label"], "vec_id", "pose", "opening")
    return rounded(out.select("label", "vec_id", F.posexplode("action").alias("dim", "value")))


_JUMPS = f"""{_V}, {_UNIT}, j AS (SELECT label, vec_id, s, lag(s) OVER k AS ps, sqrt(pow(e[1] - lag(e[1]) OVER k, 2) + pow(e[2] - lag(e[2]) OVER k, 2) + pow(e[3] - lag(e[3]) OVER k, 2)) * 30 AS speed, 2 * acos(least(1, abs(x * lag(x) OVER k + y * lag(y) OVER k + z * lag(z) OVER k + w * lag(w) OVER k))) * 30 AS turn FROM u WINDOW k AS (PARTITION BY label ORDER BY vec_id)), jumps AS (SELECT * FROM j WHERE s * s > 1e-12 AND ps * ps > 1e-12 AND (speed > 5 OR turn > 20))"""


def pose_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = label_poses(spark, sf_dir)
    return e.select(F.col("label").cast("string").alias("episode_id"), F.lit("pose").alias("stream"), F.col("vec_id").alias("frame_index"), F.col("pose").alias("values"))


@query(f"WITH {_JUMPS} SELECT label::VARCHAR AS episode_id, vec_id AS frame_index, round(speed, 4) AS speed, round(turn, 4) AS turn FROM jumps")
def pose_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.pose_jumps(pose_rows(spark, sf_dir)).select("episode_id", "frame_index", "speed", "turn"))


@query(f"WITH {_JUMPS}, n AS (SELECT label, count(*) AS n FROM jumps GROUP BY 1) SELECT label::VARCHAR AS episode_id, 'umi.slam_continuity' AS rule, CASE WHEN n >= 10 THEN 'fail' WHEN n > 0 THEN 'warn' ELSE 'pass' END AS status, coalesce(n, 0)::DOUBLE AS value FROM (SELECT DISTINCT label FROM v) LEFT JOIN n USING (label)")
def slam_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.slam_continuity(pose_rows(spark, sf_dir)).drop("stream", "message")


def tracked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return read(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") / 30).alias("t"), F.slice(v, 1, 3).alias("a"), F.transform(F.slice(v, 1, 3), lambda x: -x + 1).alias("b"))


@query(f"""WITH {_V}, p AS (SELECT label, vec_id / 30.0::DOUBLE AS t, e[1:3] AS a, list_transform(e[1:3], lambda x: 1 - x) AS b FROM v), d AS (SELECT *, sqrt(list_sum(list_transform(range(1, 4), lambda i: pow(a[i] - b[i], 2)))) AS err, sqrt(list_sum(list_transform(range(1, 4), lambda i: pow(a[i] - la[i], 2)))) AS step FROM (SELECT *, lag(a) OVER (PARTITION BY label ORDER BY t) AS la FROM p)),
f AS (SELECT x.label, x.t, x.a, x.b, min(y.t) AS t2 FROM p x JOIN p y ON x.label = y.label AND y.t >= x.t + 1 GROUP BY ALL), g AS (SELECT f.label, sqrt(avg(list_sum(list_transform(range(1, 4), lambda i: pow((y.a[i] - f.a[i]) - (y.b[i] - f.b[i]), 2))))) AS rpe FROM f JOIN p y ON f.label = y.label AND y.t = t2 GROUP BY 1)
SELECT label::BIGINT AS label, count(*) AS n, round(sqrt(avg(err * err)), 4) AS ate_rmse, round(avg(err), 4) AS ate_mean, round(quantile_cont(err, 0.5), 4) AS ate_median, round(quantile_cont(err, 0.95), 4) AS ate_p95, round(max(err), 4) AS ate_max, round(any_value(rpe), 4) AS rpe_rmse, round(sum(step), 4) AS length, round(sum(step), 4) AS true_length, round(max_by(err, t), 4) AS end_error FROM d LEFT JOIN g USING (label) GROUP BY 1""")
def trajectory_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(poses.trajectory_errors(tracked_pairs(spark, sf_dir), ["label"], "t", "a", "b", align=False))


@query()
def trajectory_errors_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After the best rigid motion, which needs a singular value decomposition; tested against the array form."""
    return rounded(poses.trajectory_errors(tracked_pairs(spark, sf_dir), ["label"], "t", "a", "b"))


@query(f"""WITH {_N}, c AS (SELECT user_id, us // {DAY} AS day, count(*) FILTER (event_type <> 'error') AS n FROM e GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM c), w AS (SELECT *, min(CASE WHEN n > 0 THEN i END) OVER k AS a, max(CASE WHEN n > 0 THEN i END) OVER k AS z FROM i WINDOW k AS (PARTITION BY user_id)), m AS (SELECT user_id, quantile_cont(CASE WHEN n > 0 THEN n END, 0.5) AS mid FROM i GROUP BY 1)
SELECT user_id, count(*) AS "rows", sum(n)::BIGINT AS samples, count(*) FILTER (n = 0 AND i BETWEEN a AND z) AS empty_inside, count(*) FILTER (n = 0 AND NOT coalesce(i BETWEEN a AND z, false)) AS empty_edge, count(*) FILTER (n > greatest(3 * mid, mid + 3)) AS bursts FROM w JOIN m USING (user_id) GROUP BY 1""")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("us") / DAY).cast("long").alias("day")).agg(F.collect_list(F.when(F.col("event_type") != "error", F.col("value"))).alias("samples"))
    return rounded(clocks.counts(own, ["user_id"], ["day"], "samples"))


@query(f"""WITH {_N}, s AS (SELECT user_id, us // {DAY} AS day, list(us) FILTER (event_type IN ('view', 'click')) AS t, list(value) FILTER (event_type IN ('view', 'error')) AS v FROM e GROUP BY ALL)
SELECT user_id, count(*) FILTER (t IS NOT NULL AND v IS NULL) AS no_values, count(*) FILTER (v IS NOT NULL AND t IS NULL) AS no_times FROM s GROUP BY 1""")
def presence_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    own = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("us") / DAY).alias("day")).agg(F.collect_list(F.when(kind.isin("view", "click"), F.col("us"))).alias("t"), F.collect_list(F.when(kind.isin("view", "error"), F.col("value"))).alias("v"))
    return audits.presence_mismatch(own, ["user_id"], "t", "v")


@query(f"""WITH {_E}, s AS (SELECT user_id, event_type AS stream, count(*)::BIGINT AS samples, (max(us) - min(us)) / 1e6 AS span FROM e GROUP BY ALL), w AS (SELECT *, max(samples) OVER (PARTITION BY user_id) - samples AS missing, max(samples) OVER (PARTITION BY user_id) AS most, max(span) OVER (PARTITION BY user_id) AS longest FROM s)
SELECT user_id, stream, missing, CASE WHEN missing > greatest(2.0, most * 0.001) AND (longest - span) * 0.0001 >= missing / 2.0 THEN 'span' WHEN missing > greatest(2.0, most * 0.001) THEN 'rate' END AS cause FROM w""")
def cross_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).groupBy("user_id", F.col("event_type").alias("stream")).agg(F.count("*").alias("samples"), ((F.max("us") - F.min("us")) / 1e6).alias("span"))
    return audits.cross_counts(s.withColumn("clock", F.lit("wall")).withColumn("rate", F.lit(0.0001)), ["user_id"]).select("user_id", "stream", "missing", "cause")


@query(f"""WITH {_N}, d AS (SELECT user_id, frame, us::DOUBLE AS r, (value * 1000000)::DOUBLE AS d, ntile(20) OVER (PARTITION BY user_id ORDER BY frame) AS part FROM e), m AS (SELECT user_id, part, quantile_cont(d, 0.5) AS m FROM d GROUP BY ALL), t AS (SELECT user_id, max(abs(s)) AS step FROM (SELECT user_id, m - lag(m) OVER (PARTITION BY user_id ORDER BY part) AS s FROM m) GROUP BY 1),
o AS (SELECT user_id, count(*) AS n, quantile_cont(d, 0.5) AS median, quantile_cont(d, 0.75) - quantile_cont(d, 0.25) AS iqr FROM d GROUP BY 1)
SELECT user_id, n, round(median, 0) AS median, round(iqr, 0) AS iqr, round(step, 0) AS step, CASE WHEN abs(median) > 100000000 OR iqr > 60000000 THEN 'error' WHEN abs(median) > 25000000 OR iqr > 20000000 THEN 'warn' ELSE 'info' END AS severity FROM o JOIN t USING (user_id)""")
def reference_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = numbered_events(spark, sf_dir).withColumn("stamp", F.col("us") + F.col("value") * 1_000_000)
    return rounded(audits.offsets(e, ["user_id"], "frame", "stamp", "us").select("user_id", "n", "median", "iqr", "step", "severity"), 0)


@query(f"""WITH {_N}, s AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY frame) AS step FROM e), c AS (SELECT *, coalesce(step BETWEEN {3 * HOUR} AND {9 * HOUR}, false) AS ok FROM s), k AS (SELECT *, sum(ok::INT) OVER (PARTITION BY user_id ORDER BY frame) AS nth FROM c), f AS (SELECT user_id, avg(step) AS mean, count(*) AS n FROM k WHERE ok AND nth <= 5 GROUP BY 1), o AS (SELECT user_id, min_by(us, frame) AS origin FROM e GROUP BY 1)
SELECT k.user_id, frame, (origin + (frame - 1) * CASE WHEN n = 5 AND nth >= 5 THEN round_even(mean, 0) ELSE {6 * HOUR} END)::BIGINT AS even FROM k JOIN o USING (user_id) LEFT JOIN f USING (user_id)""")
def online_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clocks.online_uniform(numbered_events(spark, sf_dir), ["user_id"], ["frame"], "us", 6 * HOUR, lock=5).select("user_id", "frame", "even")


@query(f"""WITH {_N}, s AS (SELECT *, us - lag(us) OVER w AS step FROM e WINDOW w AS (PARTITION BY user_id ORDER BY frame)), m AS (SELECT user_id, quantile_cont(step, 0.5) AS mid FROM s GROUP BY 1), b AS (SELECT user_id, avg(step) AS beta FROM s JOIN m USING (user_id) WHERE step BETWEEN mid * 0.5 AND mid * 1.5 GROUP BY 1),
t AS (SELECT user_id, frame, first_value(us) OVER w // 1000 + round_even((first_value(us) OVER w % 1000 + sum(CASE WHEN step IS NULL THEN 0::DOUBLE WHEN step > 1.5 * mid THEN step ELSE coalesce(beta, mid) END) OVER w) / 1000, 0)::BIGINT AS tick FROM s JOIN m USING (user_id) LEFT JOIN b USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY frame)) SELECT user_id, frame, ((max(tick - frame) OVER (PARTITION BY user_id ORDER BY frame) + frame) * 1000)::BIGINT AS rebuilt FROM t""")
def host_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clocks.rebuilt_from_host(numbered_events(spark, sf_dir), ["user_id"], ["frame"], "us").select("user_id", "frame", F.col("rebuilt").cast("long").alias("rebuilt"))


@query(f"""WITH RECURSIVE {_N}, t AS (SELECT user_id, frame, us // {DAY} AS t FROM e), r(user_id, frame, repaired) AS (SELECT user_id, frame, t FROM t WHERE frame = 1 UNION ALL SELECT t.user_id, t.frame, CASE WHEN t.t > r.repaired THEN t.t ELSE r.repaired + 2 END FROM r JOIN t ON t.user_id = r.user_id AND t.frame = r.frame + 1) SELECT * FROM r""")
def monotone_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = numbered_events(spark, sf_dir).withColumn("t", F.floor(F.col("us") / DAY).cast("long"))
    return tracks.monotone(e, ["user_id"], "frame", "t", 2)


@query("""WITH n AS (SELECT user_id, list(event_id ORDER BY event_id) AS l, bool_or(event_type = 'signup') AS done FROM events GROUP BY 1) SELECT user_id, CASE WHEN done THEN list_sum(l) ELSE list_sum(l) + 85 * len(l) END::BIGINT AS total, true AS done FROM n""")
def shifted_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("stamps"), F.bool_or(F.col("event_type") == "signup").alias("done"))
    out = clocks.shifted(clocks.shifted(own, "stamps", 85, "done"), "stamps", 85, "done")  # twice is as once
    return out.select("user_id", F.aggregate("stamps", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), "done")


@query(f"""WITH {_N}, s AS (SELECT user_id, value::BIGINT - lag(value::BIGINT) OVER w AS d, abs(us - lag(us) OVER w - (value::BIGINT - lag(value::BIGINT) OVER w) * {HOUR}) > {6 * HOUR} AS off FROM e WINDOW w AS (PARTITION BY user_id ORDER BY frame))
SELECT user_id, count(*) FILTER (d < 0) AS back, coalesce(sum(CASE WHEN d > 1 THEN d - 1 END), 0)::BIGINT AS lost, count(*) FILTER (off AND d > 0) AS off_grid FROM s GROUP BY 1""")
def sequence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = numbered_events(spark, sf_dir).withColumn("seq", F.rint("value").cast("long"))
    return rounded(audits.sequence_audit(e, ["user_id"], "frame", "seq", "us", HOUR, 6 * HOUR))


@query("""WITH s AS (SELECT user_id, bool_and(d > 0) AS increasing, count(*) AS n FROM (SELECT user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) > INTERVAL 0 SECOND AS d0, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events) GROUP BY 1) SELECT user_id, n AS "rows", coalesce(increasing, true) AS increasing FROM s""")
def increasing_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clocks.increasing(events(spark, sf_dir), ["user_id"], ["event_id"], "us")


@query(f"""WITH {_N}, a AS (SELECT user_id, frame, us FROM e WHERE event_type = 'purchase'), b AS (SELECT user_id, us, value FROM e WHERE event_type IN ('click', 'error') AND value IS NOT NULL), m AS (SELECT a.*, b.value, row_number() OVER (PARTITION BY a.user_id, a.frame ORDER BY abs(b.us - a.us), b.us) AS r FROM a LEFT JOIN b USING (user_id)) SELECT user_id, frame, value AS r_value FROM m WHERE r = 1""")
def nearest_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = numbered_events(spark, sf_dir)
    left = e.filter("event_type = 'purchase'").select("user_id", "frame", "us")
    right = e.select("user_id", "us", F.when(F.col("event_type").isin("click", "error"), F.col("value")).otherwise(float("nan")).alias("value"))
    return align.nearest_valid(left, right, ["user_id"], "us", "value").select("user_id", "frame", "r_value")


@query(f"""WITH {_N}, s AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY frame) AS run FROM (SELECT *, CASE WHEN (event_type = 'error') = lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY frame) THEN 0 ELSE 1 END AS st FROM e)), r AS (SELECT user_id, run, count(*) AS n FROM s WHERE event_type = 'error' GROUP BY ALL)
SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 10 THEN '6-10' WHEN n <= 15 THEN '11-15' ELSE '>15' END AS band, count(*) AS runs, max(n) AS longest FROM r GROUP BY 1""")
def absence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = numbered_events(spark, sf_dir).withColumn("absent", F.col("event_type") == "error")
    return runs.histogram_of_lengths(runs.runs_of(e, ["user_id"], ["frame"], "absent", "frame").filter("absent"), [])


@query(f"""WITH {_N} SELECT user_id, max(value - 20) AS peak, count(*) AS readings FROM e WHERE value >= 20 GROUP BY 1""")
def lag_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.lag_peaks(events(spark, sf_dir).withColumn("lag", F.col("value") - 20), ["user_id"], "lag")


@query(f"""WITH {_V}, p AS (SELECT label, vec_id // 9 AS f, vec_id % 9 AS point, e[1:3] AS xyz FROM v), d AS (SELECT *, lag(xyz) OVER w AS q, lag(f) OVER w AS g FROM p WINDOW w AS (PARTITION BY label, point ORDER BY f)), m AS (SELECT label, f, sqrt(pow(xyz[1] - q[1], 2) + pow(xyz[2] - q[2], 2) + pow(xyz[3] - q[3], 2)) * 2 AS d FROM d WHERE g = f - 1), k AS (SELECT label, f, quantile_cont(d, 0.5) AS mm FROM m GROUP BY ALL HAVING count(*) >= 1)
SELECT label::BIGINT AS label, CASE WHEN mm < 2 THEN '<2' WHEN mm <= 6 THEN '2-6' ELSE '>6' END AS band, count(*) AS frames, round(quantile_cont(mm, 0.5), 4) AS median, round(quantile_cont(mm, 0.9), 4) AS p90 FROM k GROUP BY ALL""")
def jitter_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("label", F.floor(F.col("vec_id") / 9).cast("long").alias("f"), (F.col("vec_id") % 9).alias("point"), F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double") * 0.002).alias("xyz"))
    return rounded(rollups.jitter_bands(e, ["label"], "f", "point", "xyz", least=1))


@query(f"""WITH {_V}, h AS (SELECT label, vec_id, list_transform(range(0, 21), lambda i: CASE WHEN (vec_id + i) % 40 = 0 THEN NULL ELSE e[i * 3 + 3] END) AS zs FROM v), s AS (SELECT label, len(list_filter(zs, lambda x: x IS NOT NULL)) AS n, zs[1] AS z, abs(zs[1] - lag(zs[1]) OVER (PARTITION BY label ORDER BY vec_id)) AS dz FROM h)
SELECT label::BIGINT AS label, round(avg((n = 21)::INT), 4) AS "full", round(quantile_cont(n, 0.5), 4) AS points, count(*) FILTER (dz > 0.1) AS flips, round(avg((z IS NOT NULL)::INT), 4) AS wrist FROM s GROUP BY 1""")
def hand_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.transform(F.col("embedding"), lambda x, j: F.when((F.col("vec_id") + F.floor(j / 3)) % 40 != 0, x.cast("double")).otherwise(float("nan")))
    e = read(spark, sf_dir, "embeddings").select("label", "vec_id", hands.points(flat).alias("points"))
    return rounded(audits.completeness(e, ["label"], "vec_id", "points"))


@query(f"""WITH {_V}, {_UNIT} SELECT label::BIGINT AS label, vec_id, unnest(range(0, 7)) AS dim, round(unnest([-e[2], e[3], -e[1], -e[5], e[6], -e[4], e[7]]), 5) AS value FROM u""")
def relabelled_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = label_poses(spark, sf_dir).withColumn("p", rotations.relabelled(F.col("pose"), (1, 2, 0), (-1, 1, -1)))
    return rounded(e.select("label", "vec_id", F.posexplode("p").alias("dim", "value")), 5)


@query()
def frame_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses of frames from trajectories on another clock; tested on known motions."""
    e = read(spark, sf_dir, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    e = e.withColumn("ts", F.row_number().over(w) / 30)
    own = F.concat(F.array(F.col("ts") + 1000), F.slice(F.col("embedding").cast("array<double>"), 1, 7))
    rows = e.select("label", "vec_id", "ts", F.when(F.col("vec_id") % 5 != 0, own).otherwise(F.array().cast("array<double>")).alias("trajectory"))
    out = poses.frame_poses(rows, ["label"], "vec_id", "ts", "trajectory")
    return rounded(out.select("label", "vec_id", F.size("pose").alias("values"), "interpolated"))


@query()
def hand_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of a day put into two slots; tested on crossing hands."""
    e = events(spark, sf_dir).select("user_id", F.floor(F.col("us") / DAY).cast("long").alias("day"), (F.col("value") / 100).alias("x"), F.lit(0.5).alias("y"), F.when(F.col("event_type") == "view", "left").when(F.col("event_type") == "click", "right").otherwise("").alias("label"))
    return rounded(tracks.slots(e, ["user_id"], "day", "x", "y", "label"))


@query()
def tactile_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pressure maps of 8 x 8 cells; tested on planted presses."""
    e = read(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double")) * 3000).alias("v"))
    return rounded(tracks.tactile_clean(e, ["label"], "vec_id", "v", rows=8, calibration=10).select("label", "vec_id", "peak"))


@query(f"""WITH {_N}, v AS (SELECT user_id, frame, us, event_type IN ('view', 'click') AS ok FROM e), p AS (SELECT *, lag(frame) OVER (PARTITION BY user_id ORDER BY frame) AS prev FROM v WHERE ok) SELECT user_id, frame, coalesce(prev <> frame - 1, false) AS gap_before FROM p""")
def gap_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = numbered_events(spark, sf_dir).filter(F.col("event_type").isin("view", "click")).select("user_id", "frame")
    return clocks.gap_flags(e, ["user_id"], "frame")


@query()
def labelled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label as a hand of 21 points, with frames that are missing; tested on planted gaps and jumps."""
    v = F.col("embedding").cast("array<double>")
    hand = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda j: F.slice(v, j * 3 + 1, 3))
    e = read(spark, sf_dir, "embeddings").select("label", "vec_id", F.when(F.col("vec_id") % 4 != 0, hand).alias("points"))
    return rounded(tracks.labelled_points(e, ["label"], "vec_id", "points", gate=2.0).select("label", "vec_id", "state", F.col("tracked")[0][0].alias("x")))
