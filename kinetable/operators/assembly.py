"""Assembly of a training dataset: the frame spine with what belongs to it, and passes over all columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.functions.values import padded
from kinetable.operators.longstreams import Stream, total


def spine(episodes: DataFrame, key: str = "episode_index", length: str = "length") -> DataFrame:
    """(key, frame_index) for every frame of every episode."""
    return episodes.filter(F.col(length) > 0).select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col(length) - 1)).alias("frame_index"))


def assembled(frames: DataFrame, parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The frames with each part's columns; parts have one row per frame at most, so rows don't multiply."""
    for part in parts:
        frames = frames.join(part, keys, "left")
    return frames


def _or(fill: Column) -> Callable[[Column], Column]:
    return lambda x: F.coalesce(x, fill)


def filled(df: DataFrame, number: float = 0.0) -> DataFrame:
    """Nulls by the end of a column's name: false for ``_valid`` and ``next.done``, -1 for ``_fingers``, nothing for
    texts, else ``number`` (0 or NaN); those within arrays too."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name.endswith("_valid") or f.name == "next.done" or isinstance(f.dataType, T.BooleanType):
            c = F.coalesce(c, F.lit(False))
        elif f.name.endswith("_fingers"):
            c = F.coalesce(c, F.lit(-1).cast(f.dataType))
        elif isinstance(f.dataType, T.StringType):
            c = F.coalesce(c, F.lit(""))
        elif isinstance(f.dataType, T.FractionalType):
            c = F.coalesce(c, F.lit(number).cast(f.dataType))
        elif isinstance(f.dataType, T.IntegralType):
            c = F.coalesce(c, F.lit(0).cast(f.dataType))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            fill = F.lit(number if isinstance(f.dataType.elementType, T.FractionalType) else 0).cast(f.dataType.elementType)
            c = F.transform(c, _or(fill))
        out.append(c.alias(f.name))
    return df.select(*out)


def narrowed(df: DataFrame) -> DataFrame:
    """Doubles as floats, within arrays too."""

    def kind(t: T.DataType) -> T.DataType:
        return T.ArrayType(kind(t.elementType), t.containsNull) if isinstance(t, T.ArrayType) else T.FloatType() if isinstance(t, T.DoubleType) else t

    return df.select(*[F.col(f"`{f.name}`").cast(kind(f.dataType)).alias(f.name) for f in df.schema.fields])


def padded_columns(df: DataFrame, endings: tuple[str, ...] = ("_matrix", "_trajectory"), fill: float = float("nan")) -> DataFrame:
    """Arrays of these columns with the length of the longest, which one pass over the data finds."""
    own = [f for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and f.name.endswith(endings)]
    if not own:
        return df
    longest = df.agg(*[F.max(F.size(f"`{f.name}`")).alias(str(i)) for i, f in enumerate(own)]).first()
    for i, f in enumerate(own):
        value = F.lit(fill if isinstance(f.dataType.elementType, T.FractionalType) else 0).cast(f.dataType.elementType)
        a = F.coalesce(F.col(f"`{f.name}`"), F.array().cast(f.dataType))
        df = df.withColumn(f.name, F.concat(a, F.array_repeat(value, F.lit(max(0, longest[i] or 0)) - F.size(a))))
    return df


def flat_samples(df: DataFrame, samples: str, stamps: str, width: int = 6, least: int = 3) -> DataFrame:
    """Lists of samples as flat arrays of equal length, NaN where there is none; their times with 0."""
    n = max(least, df.agg(F.max(F.size(samples))).first()[0] or 0)
    flat = F.flatten(F.transform(samples, lambda s: padded(F.transform(s, lambda x: x.cast("double")), width, F.lit(float("nan")))))
    return df.withColumn(samples, padded(flat, n * width, F.lit(float("nan")))).withColumn(stamps, F.concat(F.coalesce(stamps, F.array().cast("array<bigint>")), F.array_repeat(F.lit(0).cast("long"), F.lit(n) - F.greatest(F.size(stamps), F.lit(0)))))


def unpropagated(df: DataFrame, slots: dict[str, list[str]]) -> DataFrame:
    """Columns of a slot are null where its state column says that they are predicted."""
    for state, columns in slots.items():
        seen = F.coalesce(F.col(state), F.lit("")).isin("", "real")
        df = df.withColumns({c: F.when(seen, F.col(c)) for c in columns})
    return df


def constant_columns(df: DataFrame, keys: tuple[str, ...] = ()) -> list[str]:
    """Names of columns that tell nothing, by the rule of their ending; one aggregation over all columns decides.

    Errors that are NaN throughout, fingers that are -1, scores that are 0, empty gestures, a single handedness or
    source, a constant action, and numeric arrays that never change.
    """
    rules: dict[str, Column] = {}
    for f in df.schema.fields:
        c, name = F.col(f"`{f.name}`"), f.name
        numeric = isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType)
        # Two differing hashes are enough to tell; nulls count as a value of their own.
        same = F.min(F.xxhash64(c)) == F.max(F.xxhash64(c))
        if name in keys:
            continue
        if name.endswith("_reprojection_error"):
            rules[name] = F.count_if(c.isNotNull() & ~F.isnan(c)) == 0
        elif name.endswith("_fingers"):
            rules[name] = F.count_if(~c.eqNullSafe(F.lit(-1))) == 0
        elif name.endswith("_gesture_score"):
            rules[name] = F.count_if(F.coalesce(c, F.lit(0)) != 0) == 0
        elif name.endswith("_gesture"):
            rules[name] = F.count_if(F.coalesce(c.cast("string"), F.lit("")) != "") == 0
        elif name.endswith("_handedness") or (name.endswith("_source") and "_world" in name):
            held = F.when(c != "", c)
            rules[name] = F.coalesce(F.min(held) == F.max(held), F.lit(True))
        elif name == "action" or numeric:
            rules[name] = same
    if not rules:
        return []
    row = df.agg(*[F.coalesce(r, F.lit(True)).alias(str(i)) for i, r in enumerate(rules.values())], F.count("*").alias("n")).first()
    return [name for i, name in enumerate(rules) if row[i]] if row["n"] else []


def fixed_length(df: DataFrame) -> list[str]:
    """Names of arrays that have one length in all rows."""
    own = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    row = df.agg(*[(F.min(F.size(f"`{c}`")) == F.max(F.size(f"`{c}`"))).alias(str(i)) for i, c in enumerate(own)]).first() if own else ()
    return [c for i, c in enumerate(own) if row[i]]


def offsets(episodes: DataFrame, index: str = "episode_index", length: str = "length", width: int = 1000, rows: int | None = None) -> DataFrame:
    """First row and the row after the last of each episode in the whole dataset; sums run within blocks of episodes,
    or, with ``rows``, within ranges of about so many of them."""
    if rows:
        summed = Stream(episodes, [], [index], rows).add(dataset_to_index=total(length)).df
        return summed.withColumn("dataset_from_index", F.col("dataset_to_index") - F.col(length))
    b = episodes.withColumn("_b", F.floor(F.col(index) / width))
    before = b.groupBy("_b").agg(F.sum(length).alias("_s"))
    before = before.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    upto = F.sum(length).over(Window.partitionBy("_b").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)) + F.col("_o")
    return b.join(before, "_b").withColumn("dataset_to_index", upto).withColumn("dataset_from_index", F.col("dataset_to_index") - F.col(length)).drop("_b", "_o")


def task_indexes(labels: DataFrame, text: str, order: str) -> DataFrame:
    """(text, task_index) in the order in which texts come first."""
    first = labels.filter(F.col(text).isNotNull()).groupBy(text).agg(F.min(order).alias("_o"))
    # As many rows as there are different texts of tasks.
    return first.select(text, (F.row_number().over(Window.orderBy("_o", text)) - 1).cast("long").alias("task_index"))


def split(episodes: DataFrame, order: str, ratio: float = 0.9, width: int = 100_000) -> DataFrame:
    """``train`` for the first max(1, int(n ratio)) episodes by their number, ``val`` for the others.

    The last number of ``train`` lies in one block of numbers, which counts of all blocks tell; only that is sorted.
    """
    block = F.floor(F.col(order) / width)
    counts = episodes.groupBy(block.alias("_b")).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_upto", F.sum("_n").over(Window.orderBy("_b"))).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    k = F.greatest(F.lit(1), F.floor(F.col("_all") * ratio))
    hit = counts.filter((F.col("_upto") >= k) & (F.col("_upto") - F.col("_n") < k)).select("_b", (k - (F.col("_upto") - F.col("_n"))).alias("nth")).first()
    cut = episodes.filter(block == hit["_b"]).select(order).orderBy(order).offset(int(hit["nth"]) - 1).limit(1).first() if hit else None
    return episodes.withColumn("split", F.when(F.col(order) <= (cut[0] if cut else 0), "train").otherwise("val"))


def hashed_split(episodes: DataFrame, key: str, ratio: float = 0.9, seed: int = 0) -> DataFrame:
    """A split that doesn't depend on order: by a hash of the key."""
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return episodes.withColumn("split", F.when(u < ratio, "train").otherwise("val"))


def features(df: DataFrame) -> dict[str, dict]:
    """dtype and shape of each column, from the schema and, for arrays, their length in the first row that has one."""
    names = {T.FloatType: "float32", T.DoubleType: "float64", T.LongType: "int64", T.IntegerType: "int32", T.ShortType: "int16", T.ByteType: "int8", T.BooleanType: "bool", T.StringType: "string"}
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    sizes = df.agg(*[F.max(F.size(f"`{c}`")).alias(str(i)) for i, c in enumerate(arrays)]).first() if arrays else ()
    out = {}
    for f in df.schema.fields:
        t = f.dataType
        inner = t.elementType if isinstance(t, T.ArrayType) else t
        shape = [max(0, sizes[arrays.index(f.name)] or 0)] if isinstance(t, T.ArrayType) else [1]
        out[f.name] = {"dtype": names.get(type(inner), inner.simpleString()), "shape": shape}
    return out


def with_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Columns under their canonical names, unless those are there."""
    return df.withColumnsRenamed({a: b for a, b in aliases.items() if a in df.columns and b not in df.columns})


def sampled(df: DataFrame, by: list[str], order: str, most: int) -> DataFrame:
    """At most ``most`` rows of each key, evenly spread, first and last among them."""
    w = Window.partitionBy(*by)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    # Row i is the rint(k (n - 1) / (most - 1)) of some k.
    steps = F.greatest(F.col("_n") - 1, F.lit(1))
    k = F.rint(F.col("_i") * (most - 1) / steps)
    hit = F.rint(k * steps / max(1, most - 1)) == F.col("_i")
    return rows.filter((F.col("_n") <= most) | hit).drop("_i", "_n")


def trimmed(df: DataFrame, index: str, keep: int) -> DataFrame:
    return df.filter(F.col(index) < keep)


def fingerprint(df: DataFrame, by: list[str], order: list[str], ignore: tuple[str, ...] = ("episode_index",)) -> DataFrame:
    """One hash of each group's rows in order, without some columns: groups of equal content have equal hashes.

    Rows are hashed with their place and summed up, so that no group is gathered.
    """
    own = [F.col(c) for c in df.columns if c not in ignore and c not in by]
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    rows = df.select(*by, F.xxhash64(place, *own).alias("a"), F.xxhash64(*own, place, F.lit(7)).alias("b"))
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    return rows.groupBy(*by).agg(F.md5(F.concat_ws(":", F.count("*"), total("a"), total("b"))).alias("fingerprint"), F.count("*").alias("rows"))


#: Fixed form of the names of pose columns: an optional camera, and which kind of two.
POSE_COLUMN = re.compile(r"observation\.(?:(?P<camera>.+)_)?slam_(?P<kind>trajectory|pose)")


def pose_columns(columns: list[str]) -> dict[str, str]:
    """Of each camera ("" for the only one) its pose column: the trajectory, or the pose where there is none."""
    found = sorted((m["camera"] or "", m["kind"], c) for c in columns if (m := POSE_COLUMN.fullmatch(c)))
    return {camera: c for camera, _, c in found}  # by kind, "trajectory" comes last


def with_pose_and_state(frames: DataFrame, by: str = "episode_index", index: str = "frame_index", ts: str = "timestamp") -> DataFrame:
    """Frames with ``observation.slam_pose``, made from trajectories where the dataset has none, and with
    ``observation.state``: the place relative to the episode's first pose, and the opening (0 to 1) of the gripper.

    Columns that are there stay as they are; a frame whose pose has no finite place has no state.
    """
    from kinetable.operators.poses import frame_poses

    pose, state, trajectory, grip = (f"observation.{c}" for c in ("slam_pose", "state", "slam_trajectory", "gripper_state"))
    if pose not in frames.columns and trajectory in frames.columns:
        plain = frames.select(by, index, ts, F.col(f"`{trajectory}`").alias("_trajectory"))
        made = frame_poses(plain, [by], index, ts, "_trajectory").select(by, index, F.col("pose").alias(pose))
        frames = frames.join(made, [by, index], "left")
    if state in frames.columns or pose not in frames.columns:
        return frames
    place = F.transform(F.slice(F.col(f"`{pose}`"), 1, 3), lambda x: x.cast("double"))
    fine = (F.size(place) == 3) & F.forall(place, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    own = frames.withColumn("_at", F.when(fine, place))
    origin = F.first("_at", ignorenulls=True).over(Window.partitionBy(by).orderBy(index).rowsBetween(Window.unboundedPreceding, 0))
    opening = F.get(F.col(f"`{grip}`"), F.lit(0)).cast("double") / 100 if grip in frames.columns else F.lit(0.0)
    opening = F.coalesce(F.least(F.greatest(F.nanvl(opening, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    moved = F.concat(F.zip_with("_at", "_origin", lambda a, b: a - b), F.array(opening))
    return own.withColumn("_origin", origin).withColumn(state, F.when(F.col("_at").isNotNull(), moved)).drop("_at", "_origin")
