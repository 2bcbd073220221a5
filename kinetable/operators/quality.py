"""Data-quality rules: each is a function from an episode's streams to findings, held in a registry.

Tables hold all episodes; a rule is a grouping by (episode_id, stream) with a condition, so that it runs over any
number of episodes at once.  Findings have the columns of ``FINDING``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetable.functions.rotations import is_valid, orientation, position, turn_between
from kinetable.functions.values import minus, norm, worst
from kinetable.operators.runs import changes, frozen
from kinetable.operators.stats import half_drift
from kinetable.sources.datasets import stored

# Fixed vocabularies, worst status first.
SEVERITY = ("error", "fail", "pending_review", "warn", "pass")
BLOCKING = ("fail", "error")
MODALITY_CHANNELS = {
    "mono_rgb": ("rgb", "time"),
    "stereo_rgb": ("rgb", "time"),
    "rgbd_camera": ("rgb", "depth", "time"),
    "stereo_rgbd_camera": ("rgb", "depth", "time"),
    "glove_sensor": ("tactile", "device_status", "imu", "time"),
    "gripper_device": ("rgb", "slam", "gripper_state", "force", "action", "time"),
}
TRAINING_USES = {
    "pure_vision": ("rgb", "time"),
    "vision_gripper_joint": ("rgb", "gripper_state", "time"),
    "slam_trajectory": ("slam", "time"),
    "vision_tactile_joint": ("rgb", "tactile", "time"),
    "bimanual_tactile": ("tactile", "time"),
}
FINDING = ("episode_id", "rule", "status", "stream", "message", "value")
KEY = ["episode_id", "stream"]
#: Rows of a stream beyond which it is cut into ranges.
LONG = 100_000
#: A rule gets the stream's rows (episode_id, stream, frame_index, ...) or its probe report.
Rule = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Check:
    slug: str
    version: str
    channels: tuple[str, ...]
    modalities: tuple[str, ...]
    run: Rule
    params: dict = field(default_factory=dict)


CHECKS: dict[str, Check] = {}


def check(slug: str, version: str, channels: tuple[str, ...], modalities: tuple[str, ...] = (), **params) -> Callable[[Rule], Rule]:
    def add(rule: Rule) -> Rule:
        if slug in CHECKS:
            raise ValueError(f"{slug} is registered already")
        CHECKS[slug] = Check(slug, version, channels, modalities, rule, params)
        return rule

    return add


def revision(checks: dict[str, Check] | None = None) -> str:
    """24 hex digits for the rules and their versions."""
    names = sorted(f"{c.slug}@{c.version}" for c in (checks or CHECKS).values())
    return hashlib.sha256("|".join(names).encode()).hexdigest()[:24]


def revisions(applied: DataFrame, checks: dict[str, Check] | None = None) -> DataFrame:
    """The same of each episode's own rules, from (episode_id, slug)."""
    versions = F.create_map(*[F.lit(x) for c in (checks or CHECKS).values() for x in (c.slug, f"{c.slug}@{c.version}")])
    names = F.array_join(F.array_sort(F.collect_set(versions[F.col("slug")])), "|")
    return applied.groupBy("episode_id").agg(F.substring(F.sha2(names.cast("binary"), 256), 1, 24).alias("revision"))


def found(df: DataFrame, rule: str, status: Column, value: Column | str, message: str) -> DataFrame:
    stream = F.col("stream") if "stream" in df.columns else F.lit(None).cast("string")
    v = F.col(value) if isinstance(value, str) else value
    return df.select("episode_id", F.lit(rule).alias("rule"), status.alias("status"), stream.alias("stream"), F.lit(message).alias("message"), v.cast("double").alias("value"))


def graded(x: Column, warn: Column, fail: Column) -> Column:
    return F.when(fail, "fail").when(warn, "warn").otherwise("pass")


VIDEO = ("mono_rgb", "stereo_rgb", "rgbd_camera", "stereo_rgbd_camera", "gripper_device")


@check("video.decode_error", "1", ("rgb",), VIDEO)
def decode_error(probe: DataFrame) -> DataFrame:
    """Probe reports (reason, decode_errors)."""
    status = F.when(F.col("reason") == "decoder_missing", "error").when(F.col("reason").isNotNull() | (F.col("decode_errors") > 0), "fail").otherwise("pass")
    return found(probe, "video.decode_error", status, "decode_errors", "frames that can't be decoded")


@check("video.black_screen", "1", ("rgb",), VIDEO, least=0.5, share=0.05)
def black_screen(probe: DataFrame) -> DataFrame:
    """Probe reports (duration, black_ranges array<struct<start, end>>)."""
    total = F.aggregate(F.filter("black_ranges", lambda r: r["end"] - r["start"] >= 0.5), F.lit(0.0), lambda s, r: s + r["end"] - r["start"])
    own = probe.withColumn("_s", F.try_divide(total, F.col("duration")))
    return found(own, "video.black_screen", graded(F.col("_s"), F.col("_s") > 0, F.col("_s") >= 0.05), "_s", "share of the time that is black")


@check("video.freeze", "1", ("rgb",), VIDEO, warn=2.0, fail=10.0)
def freeze(probe: DataFrame) -> DataFrame:
    """Probe reports (freeze_ranges)."""
    longest = F.coalesce(F.array_max(F.transform("freeze_ranges", lambda r: r["end"] - r["start"])), F.lit(0.0))
    return found(probe, "video.freeze", graded(longest, longest >= 2.0, longest >= 10.0), longest, "longest still picture")


@check("video.frame_drop", "1", ("rgb", "time"), VIDEO, share=0.005)
def frame_drop(probe: DataFrame) -> DataFrame:
    """Probe reports (frame_count, rows)."""
    off = F.abs(F.col("frame_count") - F.col("rows"))
    most = F.greatest(F.lit(2), (F.col("rows") * 0.005).cast("long"))
    return found(probe, "video.frame_drop", graded(off, off > most, off > 5 * most), off, "video frames against rows")


@check("glove.array_shape", "1", ("tactile",), ("glove_sensor",), width=256, share=0.01)
def array_shape(rows: DataFrame, width: int = 256) -> DataFrame:
    own = rows.groupBy(*KEY).agg(F.avg((F.coalesce(F.size("values"), F.lit(-1)) != width).cast("double")).alias("v"))
    return found(own, "glove.array_shape", graded(F.col("v"), F.col("v") > 0, F.col("v") > 0.01), "v", "share of arrays of another length")


@check("glove.device_status", "1", ("device_status",), ("glove_sensor",))
def device_status(rows: DataFrame) -> DataFrame:
    own = changes(rows, KEY, ["frame_index"], "status")
    status = F.when(F.col("distinct") > 1, "fail").when((F.col("blank") > 0) | (F.coalesce("statuses", F.lit("")) != "connected"), "warn").otherwise("pass")
    return found(own, "glove.device_status", status, "changes", "changes of the device's status")


@check("glove.frozen_array", "1", ("tactile",), ("glove_sensor",), warn=40, fail=300)
def frozen_array(rows: DataFrame, most: int = LONG) -> DataFrame:
    """Streams of more than ``most`` rows are cut into ranges, so that none is one task."""
    runs = frozen(rows, KEY, ["frame_index"], "values", "frame_index", rows=most).groupBy(*KEY).agg(F.max("length").alias("longest"))
    own = rows.select(*KEY).distinct().join(runs, KEY, "left").fillna(0, ["longest"])
    return found(own, "glove.frozen_array", graded(F.col("longest"), F.col("longest") >= 40, F.col("longest") >= 300), "longest", "longest run of one array")


@check("glove.gate_floor", "1", ("tactile",), ("glove_sensor",), floor=500, share=0.05)
def gate_floor(rows: DataFrame) -> DataFrame:
    low = F.sum(F.size(F.filter("values", lambda x: (x > 0) & (x < 500))))
    own = rows.groupBy(*KEY).agg(F.try_divide(low, F.sum(F.size(F.filter("values", lambda x: x > 0)))).alias("v")).fillna(0.0, ["v"])
    return found(own, "glove.gate_floor", graded(F.col("v"), F.col("v") > 0, F.col("v") > 0.05), "v", "share of positive values under the gate")


@check("glove.no_contact", "1", ("tactile",), ("glove_sensor",))
def no_contact(rows: DataFrame) -> DataFrame:
    own = rows.groupBy(*KEY).agg(F.avg(F.exists("values", lambda x: x > 0).cast("double")).alias("v")).fillna(0.0, ["v"])
    return found(own, "glove.no_contact", F.when(F.col("v") <= 0, "warn").otherwise("pass"), "v", "share of frames with contact")


@check("umi.action_present", "1", ("action",), ("gripper_device",), rows=5000, coverage=0.95)
def action_present(rows: DataFrame, first: int = 5000) -> DataFrame:
    """No action, or one that never changes over the first rows that have any, fails."""
    usable = F.coalesce(F.size("values") > 0, F.lit(False))
    nth = F.sum(usable.cast("int")).over(Window.partitionBy(*KEY).orderBy("frame_index"))
    own = rows.withColumn("_u", usable).withColumn("_n", nth)
    cover = own.groupBy(*KEY).agg(F.avg(F.col("_u").cast("double")).alias("v"))
    cells = own.filter(F.col("_u") & (F.col("_n") <= first)).select(*KEY, F.posexplode("values").alias("i", "x"))
    spread = cells.groupBy(*KEY, "i").agg((F.max("x") - F.min("x")).alias("d")).groupBy(*KEY).agg(F.max("d").alias("d"))
    own = cover.join(spread, KEY, "left")
    return found(own, "umi.action_present", graded(F.col("v"), F.col("v") < 0.95, F.coalesce(F.col("d") <= 1e-9, F.lit(True))), "v", "share of rows with an action")


@check("umi.av_sync", "1", ("time",), ("gripper_device",), slack=2)
def av_sync(counts: DataFrame) -> DataFrame:
    """Counts (episode_id, stream, kind, rows) of streams, held against the first rgb one."""
    first = counts.filter("kind = 'rgb'").groupBy("episode_id").agg(F.min_by("rows", "stream").alias("_rgb"))
    own = counts.filter("kind <> 'rgb'").join(first, "episode_id").withColumn("_d", F.abs(F.col("rows") - F.col("_rgb")))
    return found(own, "umi.av_sync", F.when(F.col("_d") > 2, "fail").otherwise("pass"), "_d", "rows against those of the video")


@check("umi.gripper_range", "1", ("gripper_state",), ("gripper_device",), share=0.01)
def gripper_range(rows: DataFrame) -> DataFrame:
    x = F.get("values", F.lit(0))
    own = rows.groupBy(*KEY).agg(F.avg((~x.between(0, 100)).cast("double")).alias("v"))
    return found(own, "umi.gripper_range", F.when(F.col("v") > 0.01, "warn").otherwise("pass"), "v", "share of states outside 0 to 100")


@check("umi.force_baseline", "1", ("force",), ("gripper_device",), drift=200.0)
def force_baseline(rows: DataFrame) -> DataFrame:
    own = half_drift(rows.withColumn("_f", norm(F.slice("values", 1, 3))), KEY, ["frame_index"], "_f").withColumn("_d", F.abs("drift"))
    return found(own, "umi.force_baseline", F.when(F.col("_d") > 200.0, "warn").otherwise("pass"), "_d", "shift of the median force between halves")


def pose_jumps(rows: DataFrame, fps: float = 30.0, speed: float = 5.0, turn: float = 20.0) -> DataFrame:
    """Rows whose pose lies too far from the one before; pairs with an invalid pose are no jumps."""
    w = Window.partitionBy(*KEY).orderBy("frame_index")
    s = rows.withColumn("_ok", is_valid("values")).withColumn("_p", F.lag("values").over(w)).withColumn("_pok", F.lag("_ok").over(w))
    s = s.filter("_ok and _pok")
    v = norm(minus(position(F.col("values")), position(F.col("_p")))) * fps
    r = turn_between(orientation(F.col("_p")), orientation(F.col("values"))) * fps
    return s.withColumn("speed", v).withColumn("turn", r).filter((F.col("speed") > speed) | (F.col("turn") > turn)).drop("_ok", "_p", "_pok")


@check("umi.slam_continuity", "1", ("slam",), ("gripper_device",), jumps=10)
def slam_continuity(rows: DataFrame) -> DataFrame:
    n = pose_jumps(rows).groupBy(*KEY).agg(F.count("*").alias("n"))
    own = rows.select(*KEY).distinct().join(n, KEY, "left").fillna(0, ["n"])
    return found(own, "umi.slam_continuity", graded(F.col("n"), F.col("n") > 0, F.col("n") >= 10), "n", "jumps of the pose")


@check("umi.slam_coverage", "1", ("slam",), ("gripper_device",), warn=0.02, fail=0.1)
def slam_coverage(rows: DataFrame) -> DataFrame:
    """Rows with ``interpolated``."""
    own = rows.groupBy(*KEY).agg(F.avg(F.col("interpolated").cast("double")).alias("v"))
    return found(own, "umi.slam_coverage", graded(F.col("v"), F.col("v") >= 0.02, F.col("v") >= 0.1), "v", "share of interpolated poses")


def run_checks(tables: dict[str, DataFrame], chosen: list[str] | None = None) -> DataFrame:
    """Findings of the checks whose table is there (by slug).  Each is worked out and stored by itself, so that one that
    fails, in planning or at any row, gives an error finding and the others go on."""
    out: DataFrame | None = None
    for slug in chosen or sorted(CHECKS):
        if slug not in tables:
            continue
        try:
            own = CHECKS[slug].run(tables[slug])
            own = stored(own.withColumn("episode_id", F.col("episode_id").cast("string")), "findings")
        except Exception as e:
            spark: SparkSession = tables[slug].sparkSession
            own = spark.createDataFrame([(None, slug, "error", None, str(e)[:200], None)], "episode_id string, rule string, status string, stream string, message string, value double")
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no check has a table")
    return out


def applicable(episodes: DataFrame, cross_modal: bool = True, enabled: list[str] | None = None, disabled: list[str] | None = None) -> DataFrame:
    """(episode_id, slug): checks whose channels an episode (channels, modalities) has and whose modality is among its own."""
    spark = episodes.sparkSession
    rules = [(c.slug, list(c.channels), list(c.modalities)) for c in CHECKS.values() if (enabled is None or c.slug in enabled) and c.slug not in (disabled or [])]
    table = F.broadcast(spark.createDataFrame(rules, "slug string, needs array<string>, cards array<string>"))  # as many rows as there are checks
    fits = (F.size(F.array_except("needs", "channels")) == 0) & ((F.size("cards") == 0) & F.lit(cross_modal) | F.arrays_overlap("cards", "modalities"))
    return episodes.join(table, fits).select("episode_id", "slug")


def inferred_modalities(channels: Column, hint: Column) -> Column:
    """The hinted ones and the one that the channels tell: a gripper before a glove, then depth, then colour."""
    has = lambda c: F.array_contains(channels, c)
    own = F.when(has("slam") | has("gripper_state"), "gripper_device").when(has("tactile"), "glove_sensor").when(has("depth"), "rgbd_camera").when(has("rgb"), "mono_rgb")
    return F.array_distinct(F.concat(hint, F.array_compact(F.array(own))))


def channels_for(modalities: Column) -> Column:
    known = F.create_map(*[x for k, v in MODALITY_CHANNELS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.flatten(F.transform(modalities, lambda m: F.coalesce(F.element_at(known, m), F.array().cast("array<string>")))))


def resolved_config(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """(episode_id, slug, param, value): a default, or the override of the first device that has one."""
    first = overrides.groupBy("episode_id", "slug", "param").agg(F.min_by("value", "device_pos").alias("_own"))
    return defaults.join(first, ["episode_id", "slug", "param"], "left").withColumn("value", F.coalesce("_own", "value")).drop("_own")


def stream_rollup(findings: DataFrame) -> DataFrame:
    """Per stream the worst status and the reasons for it."""
    bad = F.filter(F.array_sort(F.collect_list(F.when(F.col("status") != "pass", F.col("rule")))), lambda x: x.isNotNull())
    return findings.groupBy("episode_id", "stream").agg(worst("status", SEVERITY).alias("status"), F.array_join(F.array_distinct(bad), ",").alias("reasons"), F.count("*").alias("findings"))


def episode_rollup(streams: DataFrame) -> DataFrame:
    named = lambda s: F.array_join(F.array_sort(F.collect_list(F.when(F.col("status").isin(*s), F.col("stream")))), ",")
    out = streams.groupBy("episode_id").agg(worst("status", SEVERITY).alias("status"), named(BLOCKING).alias("failed"), named(["warn"]).alias("warned"), named(["pending_review"]).alias("pending"))
    return out.withColumn("blocking", F.col("status").isin(*BLOCKING))


def training_uses(episodes: DataFrame) -> DataFrame:
    """(episode_id, use, usable, missing) for each use, from channels and status of episodes."""
    rules = F.array(*[F.struct(F.lit(u).alias("use"), F.array(*map(F.lit, r)).alias("needs")) for u, r in TRAINING_USES.items()])
    rows = episodes.withColumn("_r", F.explode(rules)).withColumn("_m", F.array_except("_r.needs", "channels"))
    return rows.select("episode_id", F.col("_r.use").alias("use"), ((F.size("_m") == 0) & ~F.col("status").isin(*BLOCKING)).alias("usable"), F.array_join("_m", ",").alias("missing"))


def timeline(streams: DataFrame) -> DataFrame:
    """Ranges (array<struct<start_sec, end_sec, code>>) of all streams by time, without ranges equal to the one before."""
    rows = streams.select("episode_id", F.inline("ranges"))
    w = Window.partitionBy("episode_id").orderBy("start_sec", "end_sec", "code")
    same = F.struct("start_sec", "end_sec", "code").eqNullSafe(F.lag(F.struct("start_sec", "end_sec", "code")).over(w))
    return rows.withColumn("_d", same).filter("not _d").drop("_d")


def gated(states: DataFrame, reports: DataFrame) -> DataFrame:
    """States after the checks: a blocking report takes a reviewed or approved episode back to review; none is approved."""
    own = states.join(reports.select("episode_id", "blocking"), "episode_id", "left")
    back = F.coalesce(F.col("blocking"), F.lit(False)) & F.col("status").isin("completed", "reviewed", "approved")
    return own.withColumn("can_approve", ~F.coalesce(F.col("blocking"), F.lit(False))).withColumn("status", F.when(back, "to_review").otherwise(F.col("status"))).drop("blocking")


def top_ranges(ranges: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    return ranges.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def legacy_validation(rows: DataFrame, probes: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Distinct frames against the video's within a tenth, a sensor that isn't all zero in the first ten rows, a video
    that can be read, and no row that is disconnected."""
    own = rows.groupBy("episode_id").agg(F.countDistinct("frame_index").alias("frames"), F.bool_or(F.when(F.col("frame_index") < 10, F.exists("values", lambda x: x != 0))).alias("active"), F.bool_and(F.coalesce(F.col("status"), F.lit("")) != "disconnected").alias("connected"))
    own = own.join(probes.select("episode_id", "frame_count", "readable"), "episode_id", "left")
    fits = F.abs(F.col("frame_count") - F.col("frames")) <= tolerance * F.greatest(F.col("frame_count"), F.col("frames"))
    ok = F.coalesce(fits, F.lit(False)) & F.coalesce("active", F.lit(False)) & F.col("connected") & F.coalesce("readable", F.lit(False))
    return own.withColumn("aligned", F.coalesce(fits, F.lit(False))).withColumn("ok", ok)
