"""From trajectories to poses and actions, and the evaluation of trajectories against ground truth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetable.functions.rotations import local_motion, position
from kinetable.functions.values import all_finite, clamp, minus, norm
from kinetable.operators.align import asof
from kinetable.operators.stats import quantiles


def samples_of(frames: DataFrame, by: list[str], index: str, trajectory: str) -> DataFrame:
    """Flat trajectories of 8 values (t, x, y, z, qx, qy, qz, qw) as one row per sample; samples that aren't finite go."""
    n = F.floor(F.size(trajectory) / 8).cast("int")
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(trajectory, i * 8 + 1, 8)))
    rows = frames.select(*by, index, F.posexplode(parts).alias("elem", "s")).filter(all_finite("s"))
    return rows.select(*by, index, "elem", F.get("s", F.lit(0)).alias("t"), F.slice("s", 2, 7).alias("pose"))


def frame_poses(frames: DataFrame, by: list[str], index: str, ts: str, trajectory: str, tolerance: float = 1.5) -> DataFrame:
    """A pose for each frame: the trajectory's clock is fitted to the frames' by a line through each frame's last sample;
    the nearest sample within ``tolerance`` periods counts, and frames between two that have one are interpolated
    value by value, those at the ends take the nearest.  ``interpolated`` tells which."""
    s = samples_of(frames, by, index, trajectory)
    ends = s.groupBy(*by, index).agg(F.max_by("t", "elem").alias("t")).join(frames.select(*by, index, ts), [*by, index])
    line = ends.groupBy(*by).agg(F.regr_slope(ts, "t").alias("k"), F.regr_intercept(ts, "t").alias("b"))
    line = line.withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    on_clock = s.join(line, by).select(*by, (F.col("t") * F.coalesce("k", F.lit(1.0)) + F.coalesce(F.when(F.col("k").isNotNull(), F.col("b")), F.lit(0.0))).alias(ts), "pose")
    w = Window.partitionBy(*by).orderBy(index)
    period = frames.withColumn("_d", F.col(ts) - F.lag(ts).over(w)).groupBy(*by).agg(F.percentile("_d", F.lit(0.5)).alias("_period"))
    met = asof(frames.select(*by, index, ts), on_clock, by, ts, "nearest").join(period, by)
    met = met.withColumn("_p", F.when(F.abs(F.col(f"r_{ts}") - F.col(ts)) <= tolerance * F.col("_period"), F.col("r_pose")))
    at = F.when(F.col("_p").isNotNull(), F.struct(F.col(index).alias("i"), F.col("_p").alias("p")))
    back = Window.partitionBy(*by).orderBy(F.desc(index))
    met = met.withColumn("_a", F.last(at, ignorenulls=True).over(w)).withColumn("_z", F.last(at, ignorenulls=True).over(back))
    share = F.when(F.col("_z.i") == F.col("_a.i"), 0.0).otherwise((F.col(index) - F.col("_a.i")) / (F.col("_z.i") - F.col("_a.i")))
    between = F.zip_with("_a.p", "_z.p", lambda a, z: a + share * (z - a))
    raw = F.coalesce(F.col("_p"), between, F.col("_a.p"), F.col("_z.p"))
    n = norm(F.slice(raw, 4, 4))
    pose = F.concat(position(raw), F.transform(F.slice(raw, 4, 4), lambda q: F.when(n > 1e-12, q / n)))
    return met.select(*by, index, ts, pose.alias("pose"), F.col("_p").isNull().alias("interpolated"))


def actions(poses: DataFrame, by: list[str], index: str, pose: str, opening: str | None = None) -> DataFrame:
    """Seven values for each frame: motion to the next frame in its own frame, and the next gripper opening (0 to 1);
    the last frame repeats the motion before it.  ``state`` is the place relative to the first, and the opening."""
    w = Window.partitionBy(*by).orderBy(index)
    grip = F.coalesce(clamp(F.col(opening).cast("double") / 100, 0.0, 1.0), F.lit(0.0)) if opening else F.lit(0.0)
    rows = poses.withColumn("_g", grip).withColumn("_n", F.lead(pose).over(w))
    rows = rows.withColumn("_m", F.when(F.col("_n").isNotNull(), local_motion(F.col(pose), F.col("_n"))))
    rows = rows.withColumn("_m", F.coalesce("_m", F.lag("_m").over(w), F.array_repeat(F.lit(0.0), 6)))
    action = F.concat("_m", F.array(F.coalesce(F.lead("_g").over(w), F.col("_g"))))
    start = F.first(pose).over(w.rowsBetween(Window.unboundedPreceding, 0))
    state = F.concat(minus(position(F.col(pose)), position(start)), F.array("_g"))
    return rows.withColumn("action", action).withColumn("state", state).drop("_g", "_n", "_m")


def fitted(pairs: DataFrame, by: list[str], estimate: str, truth: str) -> DataFrame:
    """The keys with ``turn`` (9 values, by rows) and ``move``: the rigid motion that brings the estimates nearest to the truth.

    Sums over all pairs give it, so that no key is gathered: one row for each reaches Python.
    """
    a, b = ([F.get(F.col(c), F.lit(i)).cast("double") for i in range(3)] for c in (estimate, truth))
    sums = [F.count("*").cast("double"), *map(F.sum, a), *map(F.sum, b), *[F.sum(x * y) for x in a for y in b]]
    rows = pairs.groupBy(*by).agg(F.array(*sums).alias("_s"))
    schema = ", ".join([*(f"`{k}` {t}" for k, t in pairs.select(*by).dtypes), "turn array<double>, move array<double>"])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for s in pdf["_s"]:
                n, ca, cb = s[0], s[1:4] / s[0], s[4:7] / s[0]
                u, _, vt = np.linalg.svd(np.reshape(s[7:], (3, 3)) - n * np.outer(ca, cb))
                r = vt.T @ np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0]) @ u.T
                out.append((r.ravel().tolist(), (cb - r @ ca).tolist()))
            yield pdf.drop(columns="_s").assign(turn=[r for r, _ in out], move=[m for _, m in out])

    return rows.mapInPandas(solve, schema)


def trajectory_errors(pairs: DataFrame, by: list[str], ts: str, estimate: str, truth: str, span: float = 1.0, align: bool = True) -> DataFrame:
    """Of matched positions: absolute error after a rigid fit (rmse, mean, median, p95, max), relative error over a
    span of time, lengths of both paths, and the error at the end."""
    rows = pairs.select(*by, F.col(ts).cast("double").alias("_t"), F.col(estimate).cast("array<double>").alias("_a"), F.col(truth).cast("array<double>").alias("_b"))
    if align:
        cell = lambda i, j: F.get("turn", F.lit(3 * i + j)) * F.get("_a", F.lit(j))
        on = F.array(*[cell(i, 0) + cell(i, 1) + cell(i, 2) + F.get("move", F.lit(i)) for i in range(3)])
        rows = rows.join(fitted(rows, by, "_a", "_b"), by).select(*by, "_t", "_a", "_b", on.alias("_on"))
    else:
        rows = rows.withColumn("_on", F.col("_a"))
    w = Window.partitionBy(*by).orderBy("_t")
    path = lambda c: norm(minus(F.col(c), F.lag(c).over(w)))
    rows = rows.withColumn("_e", norm(minus("_on", "_b"))).withColumn("_pa", path("_a")).withColumn("_pb", path("_b"))
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("ate_rmse"),
        F.avg("_e").alias("ate_mean"),
        F.max("_e").alias("ate_max"),
        F.coalesce(F.sum("_pa"), F.lit(0.0)).alias("length"),
        F.coalesce(F.sum("_pb"), F.lit(0.0)).alias("true_length"),
        F.max_by("_e", "_t").alias("end_error"),
    )
    spread = quantiles(rows, by, "_e", {"ate_median": 0.5, "ate_p95": 0.95})
    # Each place against the first that is a span or more later.
    own = rows.select(*by, (F.col("_t") + span).alias("_t"), "_on", "_b")
    later = asof(own, rows.select(*by, "_t", "_on", "_b"), by, "_t", "forward").filter("r__on is not null")
    off = norm(minus(minus("r__on", "_on"), minus("r__b", "_b")))
    rel = later.groupBy(*by).agg(F.sqrt(F.avg(off * off)).alias("rpe_rmse"))
    out = sums.join(spread, by).join(rel, by, "left")
    return out.select(*by, "n", "ate_rmse", "ate_mean", "ate_median", "ate_p95", "ate_max", "rpe_rmse", "length", "true_length", "end_error")


def triangulated(points: DataFrame, left: str, right: str, p_left: np.ndarray, p_right: np.ndarray, max_error: float = 8.0, near: float = 0.05, far: float = 3.0) -> DataFrame:
    """Points in space from pixels (array of 2) in two cameras; null beyond the reprojection error or the depth range."""
    schema = ", ".join([*(f"`{n}` {t}" for n, t in points.dtypes), "xyz array<double>, error double"])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                yield pdf.assign(xyz=None, error=0.0)
                continue
            uv = [np.stack(pdf[c].to_numpy()).astype(float) for c in (left, right)]
            rows = [u[:, i : i + 1] * p[2] - p[i] for u, p in zip(uv, (p_left, p_right), strict=True) for i in (0, 1)]
            _, _, vt = np.linalg.svd(np.stack(rows, 1))
            x = vt[:, -1] / vt[:, -1, 3:]
            off = []
            for u, p in zip(uv, (p_left, p_right), strict=True):
                q = x @ p.T
                off.append(np.linalg.norm(q[:, :2] / q[:, 2:] - u, axis=1))
            e = np.maximum(*off)
            ok = (e <= max_error) & (x[:, 2] > near) & (x[:, 2] <= far)
            yield pdf.assign(xyz=[x[i, :3].tolist() if ok[i] else None for i in range(len(x))], error=e)

    return points.mapInPandas(solve, schema)


def paired_hands(pairs: DataFrame, by: list[str], left: str, right: str, points: str, error: str, same_label: str, least: int = 12, most: int = 2) -> DataFrame:
    """Of all left hands with all right hands of a frame (one row each) the pairs that are one hand.

    A pair scores ten for each point that could be placed, less its mean error, and five more if both labels are equal;
    pairs with fewer than ``least`` points don't count.  The best are taken first, each hand once: with two hands on either
    side that is the best pair and, if it shares no hand with it, the best of the others.  ``rank`` is 1 or 2.
    """
    score = F.col(points) * 10.0 - F.col(error) + F.when(F.col(same_label), 5.0).otherwise(0.0)
    w = Window.partitionBy(*by).orderBy(F.desc("score"), left, right)
    own = pairs.withColumn("score", score).filter(F.col(points) >= least).withColumn("_n", F.row_number().over(w))
    chosen = own.filter("_n = 1").withColumn("rank", F.lit(1))
    first = chosen.select(*by, F.col(left).alias("_l"), F.col(right).alias("_r"))
    rest = own.filter("_n > 1").join(first, by).filter((F.col(left) != F.col("_l")) & (F.col(right) != F.col("_r"))).drop("_l", "_r")
    if most > 1:
        chosen = chosen.unionByName(rest.withColumn("_n", F.row_number().over(w)).filter("_n = 1").withColumn("rank", F.lit(2)))
    return chosen.drop("_n")
