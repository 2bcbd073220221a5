"""Operational roll-ups: status counts, trends, progress, catalogues and their repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed names of statuses that mean the same.
STATUS_ALIASES = {"completed": "to_review", "reviewed": "approved"}


def canonical(status: Column | str) -> Column:
    c = F.col(status) if isinstance(status, str) else status
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STATUS_ALIASES.items() for x in kv]), c), c)


def of_status(df: DataFrame, status: str, wanted: list[str]) -> DataFrame:
    """Rows of these statuses, under any of their names."""
    return df.filter(canonical(status).isin([STATUS_ALIASES.get(w, w) for w in wanted]))


def alive(df: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    return df.join(tombstones.select(key).distinct(), key, "left_anti")


def search(df: DataFrame, column: str, text: str) -> DataFrame:
    return df.filter(F.contains(F.lower(F.col(column)), F.lit(text.lower())))


def matches_either_way(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def like_pattern(name: Column, pattern: str) -> Column:
    """File-name patterns with * and ?."""
    import re

    return name.rlike("^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$")


def status_summary(episodes: DataFrame, key: str, status: str, frames: str, received: str) -> DataFrame:
    """Per project and status the episodes, with the project's own mean length and last arrival."""
    by = episodes.groupBy(key, status).agg(F.count("*").alias("episodes"), F.sum(frames).alias("_s"), F.count(frames).alias("_n"), F.max(received).alias("_r"))
    w = Window.partitionBy(key)
    out = by.withColumn("avg_frames", F.try_divide(F.sum("_s").over(w), F.sum("_n").over(w))).withColumn("last_received", F.max("_r").over(w))
    return out.drop("_s", "_n", "_r")


def overview(episodes: DataFrame, status: str, day: Column, today: str) -> DataFrame:
    s = canonical(status)
    return episodes.agg(F.count("*").alias("total"), F.count_if(day == F.lit(today).cast("date")).alias("today"), *[F.count_if(s == x).alias(x) for x in ("processing", "to_review", "approved", "failed")])


def daily_trend(df: DataFrame, day: str, last: str, days: int) -> DataFrame:
    """Rows of each of the last days, 0 where there are none."""
    spark = df.sparkSession
    dates = spark.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(last).cast("date"), days - 1), F.lit(last).cast("date"))).alias("day"))
    n = df.groupBy(F.to_date(day).alias("day")).agg(F.count("*").alias("n"))
    return dates.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def progress(tasks: DataFrame, done: DataFrame, task: str, target: str) -> DataFrame:
    """Percent of the target, 100 at most, with one place."""
    n = done.groupBy(task).agg(F.count("*").alias("n"))
    out = tasks.join(n, task, "left").fillna(0, ["n"])
    share = F.when(F.col(target) > 0, F.least(F.lit(100.0), F.bround(100.0 * F.col("n") / F.col(target), 1))).otherwise(0.0)
    return out.withColumn("percent", share).withColumn("complete", (F.col(target) > 0) & (F.col("n") >= F.col(target)))


def device_totals(sessions: DataFrame, reported: DataFrame, task: str) -> DataFrame:
    """Counts that devices reported, else those of their sessions."""
    r = reported.groupBy(task).agg(F.sum("count").alias("reported"))
    s = sessions.groupBy(task).agg(F.count("*").alias("seen"))
    return s.join(r, task, "full").select(task, F.coalesce("reported", "seen").alias("total"))


def readiness(episodes: DataFrame, project: str, status: str, targets: DataFrame) -> DataFrame:
    """Projects that have as many approved episodes as they aim at, those first, then by share and number."""
    n = episodes.groupBy(project).agg(F.count("*").alias("uploaded"), F.count_if(canonical(status) == "approved").alias("approved"))
    out = n.join(targets, project, "left").withColumn("ready", F.coalesce((F.col("target") > 0) & (F.col("approved") >= F.col("target")), F.lit(False)))
    out = out.withColumn("share", F.when(F.col("target") > 0, F.col("approved") / F.col("target")).otherwise(-1.0))
    return out.orderBy(F.desc("ready"), F.desc("share"), F.desc("approved"), project)


def latest(df: DataFrame, keys: list[str], value: str, order: str, default: str | None = None) -> DataFrame:
    out = df.groupBy(*keys).agg(F.max_by(value, order).alias(value))
    return out.fillna(default, [value]) if default is not None else out


def recent(df: DataFrame, order: list, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of rows with the number of all."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def duplicate_files(files: DataFrame, folder: str, digest: str, size: str) -> DataFrame:
    """Files of equal content, in one folder or in several, the largest first."""
    g = files.groupBy(digest).agg(F.count("*").alias("files"), F.countDistinct(folder).alias("folders"), F.max(size).alias("bytes"))
    return g.filter("files > 1").withColumn("wasted", (F.col("files") - 1) * F.col("bytes")).orderBy(F.desc("bytes"), digest)


def merged_tasks(backend: DataFrame, local: DataFrame, key: str, name: str) -> DataFrame:
    """Backend and local tasks as one list: local ones that the backend lacks stay, and of one name the backend's counts.

    ``shown`` is the backend's count and what hasn't been synchronised.
    """
    b, o = backend.withColumnsRenamed({c: f"b_{c}" for c in backend.columns if c != key}), local.withColumnsRenamed({c: f"l_{c}" for c in local.columns if c != key})
    both = b.join(o, key, "full").withColumn(name, F.coalesce(f"b_{name}", f"l_{name}"))
    own = F.coalesce("l_count", F.lit(0))
    both = both.withColumn("shown", F.coalesce("b_count", F.lit(0)) + own - F.least(F.coalesce("l_synced", F.lit(0)), own))
    w = Window.partitionBy(name).orderBy(F.col(f"b_{name}").isNull(), key)
    one = both.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    target = F.coalesce("b_target", F.lit(0))
    status = F.when((target > 0) & (F.col("shown") >= target), "completed").when(F.col("shown") > 0, "in_progress").otherwise("pending")
    return one.select(key, name, "shown", status.alias("status"))


def groups_by_prefix(streams: DataFrame, name: str) -> DataFrame:
    """Camera streams by what comes before left or right; stereo if both sides are there."""
    base = F.regexp_replace(F.lower(name), r"[_.-]?(left|right|l|r)$", "")
    side = F.regexp_extract(F.lower(name), r"(left|right|l|r)$", 1)
    g = streams.withColumn("base", base).withColumn("side", F.substring(side, 1, 1)).groupBy("base")
    return g.agg(F.count("*").alias("streams"), (F.bool_or(F.col("side") == "l") & F.bool_or(F.col("side") == "r")).alias("stereo"))


def paired_channels(keys: DataFrame, name: str) -> DataFrame:
    base = F.regexp_replace(name, r"[_.]?(left|right)", "")
    side = F.regexp_extract(name, r"(left|right)", 1)
    return keys.withColumn("base", base).withColumn("side", side).groupBy("base").agg(F.max(F.when(F.col("side") == "left", F.col(name))).alias("left"), F.max(F.when(F.col("side") == "right", F.col(name))).alias("right"), F.max(F.when(F.col("side") == "", F.col(name))).alias("single"))


def best_source(rows: DataFrame, by: list[str], source: str) -> DataFrame:
    """The source with most valid points, then frames, then a left one, then by name."""
    rank = F.struct("points", "frames", F.contains(F.lower(source), F.lit("left")), source)
    return rows.groupBy(*by).agg(F.max_by(source, rank).alias(source))


def resumable(uploads: DataFrame, now: str, max_age_days: int) -> DataFrame:
    """The newest upload of each path and episode, and why it isn't taken up again."""
    w = Window.partitionBy("path", "episode").orderBy(F.desc("created_at"), F.desc("id"))
    one = uploads.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    old = F.col("created_at") < F.lit(now).cast("timestamp") - F.expr(f"interval {max_age_days} days")
    return one.withColumn("skip", F.when(F.col("status") == "done", "done").when(old, "old").when(~F.col("status").isin("pending", "failed"), "status"))


def claimable(jobs: DataFrame, now: str) -> DataFrame:
    """Jobs that a worker may take, in order: queued ones, and running ones whose lease has ended."""
    due = (F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("lease_until") < F.lit(now).cast("timestamp")))
    return jobs.filter(due).orderBy("created_at", "id")


def renamed(stores: dict[str, tuple[DataFrame, str]], old: str, new: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables with one project name for another, and how many rows of each changed."""
    out, counts = {}, None
    for name, (df, column) in stores.items():
        n = df.filter(F.col(column) == old).agg(F.count("*").alias("changed")).withColumn("store", F.lit(name))
        counts = n if counts is None else counts.unionByName(n)
        out[name] = df.withColumn(column, F.when(F.col(column) == old, new).otherwise(F.col(column)))
    return out, counts


def imported_actions(existing: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """New segments with a label and a length, without ids that are there, numbered after the last."""
    good = new.filter((F.trim(F.coalesce("label", F.lit(""))) != "") & (F.col("end_frame") > F.col("start_frame"))).dropDuplicates([*by, "id"])
    good = good.join(existing.select(*by, "id"), [*by, "id"], "left_anti")
    last = existing.groupBy(*by).agg(F.max("sort_order").alias("_last"))
    n = F.row_number().over(Window.partitionBy(*by).orderBy("start_frame", "end_frame", "id"))
    return good.join(last, by, "left").withColumn("sort_order", F.coalesce("_last", F.lit(-1)) + n).drop("_last")


def staleness(data: DataFrame, info_mtime: str) -> DataFrame:
    """Whether a dataset's newest file is later than its description, by more than a second; within an hour it may be under way."""
    late = F.max("mtime").cast("double") - F.max(F.col(info_mtime)).cast("double")
    return data.agg(late.alias("late")).withColumn("state", F.when(F.col("late") <= 1, "fresh").when(F.col("late") <= 3600, "in_flight").otherwise("stale"))


def fingers_flips(rows: DataFrame, by: list[str], order: str, label: str) -> DataFrame:
    """How often a label changes between rows that have one."""
    there = rows.filter(F.coalesce(label, F.lit("")) != "")
    w = Window.partitionBy(*by).orderBy(order)
    return there.withColumn("_p", F.lag(label).over(w)).groupBy(*by).agg(F.count_if(F.col(label) != F.col("_p")).alias("flips"), F.count("*").alias("rows"))


def bone_lengths(rows: DataFrame, by: list[str], a: str, b: str, low: float = 55.0, high: float = 115.0) -> DataFrame:
    """Distances of two points in mm (from metres): median, interquartile range, share outside of what hands have."""
    d = F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)) * 1000
    q = lambda p: F.percentile("_d", F.lit(p))
    return rows.withColumn("_d", d).groupBy(*by).agg(q(0.5).alias("median"), (q(0.75) - q(0.25)).alias("iqr"), F.avg((~F.col("_d").between(low, high)).cast("double")).alias("outside"))


def jitter_bands(points: DataFrame, by: list[str], order: str, point: str, xyz: str, least: int = 8) -> DataFrame:
    """Median displacement of each frame's points against the frame before, in mm, and how many frames fall in which band."""
    w = Window.partitionBy(*by, point).orderBy(order)
    prev, then = F.lag(xyz).over(w), F.lag(order).over(w)
    d = F.sqrt(F.aggregate(F.zip_with(xyz, "_p", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)) * 1000
    moved = points.withColumn("_p", prev).withColumn("_t", then).filter(F.col("_t") == F.col(order) - 1).withColumn("_d", d)
    frame = moved.groupBy(*by, order).agg(F.percentile("_d", F.lit(0.5)).alias("mm"), F.count("_d").alias("n")).filter(F.col("n") >= least)
    band = F.when(F.col("mm") < 2, "<2").when(F.col("mm") <= 6, "2-6").otherwise(">6")
    return frame.groupBy(*by, band.alias("band")).agg(F.count("*").alias("frames"), F.percentile("mm", F.lit(0.5)).alias("median"), F.percentile("mm", F.lit(0.9)).alias("p90"))


def union_size(history: DataFrame, current: DataFrame, by: list[str], key: str) -> DataFrame:
    """How many different keys either of two tables has."""
    both = history.select(*by, key).unionByName(current.select(*by, key))
    return both.groupBy(*by).agg(F.countDistinct(key).alias("ids"))


def effective_fps(episodes: DataFrame, cameras: DataFrame, stereo: DataFrame, key: str, default: float) -> DataFrame:
    """Frames a second at which a recording is played: the most of its cameras', else the stereo pair's, else the default."""
    most = cameras.groupBy(key).agg(F.max("fps").alias("_most"))
    own = episodes.join(most, key, "left").join(stereo, key, "left")
    return own.select(key, F.coalesce("_most", "stereo_fps", F.lit(default)).alias("fps"))


def checkpoints(files: DataFrame) -> DataFrame:
    """Files (path, length) of runs/<run>/checkpoints/<step>/ as one row for each step: files, bytes, and whether it is the newest."""
    part = lambda i: F.regexp_extract("path", r"([^/]+)/checkpoints/(\d+)/", i)
    own = files.withColumn("run", part(1)).withColumn("step", F.when(part(2) != "", part(2).cast("long"))).filter("step is not null")
    steps = own.groupBy("run", "step").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    return steps.withColumn("newest", F.col("step") == F.max("step").over(Window.partitionBy("run")))


def guessed_reference(streams: DataFrame, references: DataFrame, stream: str, mid: str, reference: str) -> DataFrame:
    """For each stream the reference whose median time is nearest to its own, the first by name of equally near.

    There are as many references as clocks of a recording, a handful.
    """
    named = references.agg(F.collect_list(F.struct(reference, F.col(mid).alias("at"))).alias("_r"))  # one row
    nearest = F.array_min(F.transform("_r", lambda r: F.struct(F.abs(r["at"] - F.col(mid)).alias("d"), r[reference].alias("name"))))
    return streams.crossJoin(F.broadcast(named)).select(stream, mid, nearest["name"].alias(reference))


def without_empty(value):
    """A JSON value without maps and lists that are empty, or become so; None if nothing is left."""
    if isinstance(value, dict):
        own = {k: without_empty(v) for k, v in value.items()}
        return {k: v for k, v in own.items() if v is not None or value[k] is None} or None
    if isinstance(value, list):
        own = [without_empty(v) for v in value]
        return [v for v, old in zip(own, value, strict=True) if v is not None or old is None] or None
    return value


def name_variants(name: str) -> set[str]:
    """The names under which a source may be stored: without its ending, side words and prefixes, in any of their orders."""
    found, rest = set(), {name.lower()}
    while rest:
        found |= rest
        rest = {v for n in rest for v in (n.rsplit(".", 1)[0], n.removeprefix("observation."), n.removeprefix("images."), n.removesuffix("_rgb"), n.replace("-", "_"))} - found - {""}
    return found


def source_variants(name: Column | str) -> Column:
    """``name_variants`` of a column, as an array: all steps are taken for as long as there may be a new one."""
    name = F.lower(F.col(name) if isinstance(name, str) else name)
    steps = (
        lambda n: F.regexp_replace(n, r"\.[^.]*$", ""),
        lambda n: F.regexp_replace(n, r"^observation\.", ""),
        lambda n: F.regexp_replace(n, r"^images\.", ""),
        lambda n: F.regexp_replace(n, "_rgb$", ""),
        lambda n: F.replace(n, F.lit("-"), F.lit("_")),
    )
    more = lambda found, _: F.array_distinct(F.flatten(F.transform(found, lambda n: F.array(n, *[step(n) for step in steps]))))
    turns = F.sequence(F.lit(1), F.size(F.split(name, r"\.")) + 4)
    return F.filter(F.aggregate(turns, F.array(name), more), lambda n: n != "")


def matched_sources(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Names of both sides that may be the same source, as they share a variant; met by variants, each pair once."""
    a = left.select(F.col(left_name).alias("name")).distinct().withColumn("_v", F.explode(source_variants("name")))
    b = right.select(F.col(right_name).alias("match")).distinct().withColumn("_v", F.explode(source_variants("match")))
    return a.join(b, "_v").select("name", "match").distinct()


def same_source(a: str, b: str) -> bool:
    return not name_variants(a).isdisjoint(name_variants(b))


def active_duplicates(uploads: DataFrame, jobs: DataFrame, episodes: DataFrame, window: float) -> DataFrame:
    """Uploads (upload, digest, at) with ``duplicate_of``: the first job of the same archive, by its name, that is queued or
    in process, or that was completed within ``window`` seconds before and whose episode is still there; else null.

    Jobs are (job, digest, status, created, episode), episodes (episode); an upload without a digest has no duplicate.
    """
    there = episodes.select("episode").distinct().withColumn("_there", F.lit(True))
    held = jobs.filter(F.coalesce("digest", F.lit("")) != "").join(there, "episode", "left")
    busy = F.col("status").isin("queued", "processing")
    live = held.select("digest", "job", "created", busy.alias("_busy"), ((F.col("status") == "completed") & F.col("_there")).alias("_done")).filter("_busy or _done")
    recent = F.greatest(F.col("at") - F.col("created"), F.lit(0.0)) <= window
    met = uploads.join(live, "digest", "left")
    fits = F.col("_busy") | (F.col("_done") & recent)
    return met.groupBy("upload", "digest", "at").agg(F.min(F.when(fits, F.col("job"))).alias("duplicate_of"))
