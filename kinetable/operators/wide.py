"""Statistics of each dimension of wide vectors, with exact quantiles, and no row for every value.

Vectors are cut into blocks of dimensions, and the blocks of a group meet as one matrix in a task, which sorts all its
columns at once.  A matrix never holds more than ``VALUES`` numbers: blocks are as narrow as the largest group asks.

A group of more than ``PIECE`` vectors is dealt to pieces.  Each piece gives a rank sketch, ``SAMPLES`` rows of its sorted
matrix at even distances, and the sketches of all pieces bracket each wanted rank of each dimension from both sides, for
certain.  A second pass counts what lies below the brackets and keeps what lies in them, about one value in a hundred
for each wanted rank; the value of the rank is found among those.  So results are exact whatever the size.

NaN is skipped and infinities count in the moments, quantiles are of finite values, as for single values
(``stats.scalar_stats``).  Null vectors are skipped; groups of vectors of different lengths are left out, and so are
dimensions without a finite value; null keys are keys; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.operators.longstreams import beside
from kinetable.operators.stats import QUANTILES, with_columns_of
from kinetable.sources.datasets import stored

#: Vectors of a piece; rows of its sketch; numbers of a matrix; the most dimensions of a block.
PIECE, SAMPLES, VALUES, BLOCK = 1 << 16, 256, 1 << 22, 4096

_MOMENTS = "mean double, std double, min double, max double"


def matrix(column: pa.ChunkedArray) -> np.ndarray | None:
    """Vectors as rows, nulls as NaN; None if they differ in length."""
    flat = column.combine_chunks()
    width = len(flat.flatten()) // max(1, len(flat))
    if pa.compute.min_max(pa.compute.list_value_length(flat)).as_py() != {"min": width, "max": width}:
        return None
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), width)


def moments(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per column: values that aren't NaN, their mean, summed squares about it, least and largest."""
    there = ~np.isnan(x)
    n = there.sum(0)
    with np.errstate(all="ignore"):
        mean = np.where(there, x, 0).sum(0) / n
        squares = np.where(there, (x - mean) ** 2, 0).sum(0)
    return n, mean, squares, np.where(there, x, np.inf).min(0), np.where(there, x, -np.inf).max(0)


def sorted_finite(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns in order, what isn't finite at their ends as infinity, and how many finite values each has."""
    fine = np.isfinite(x)
    return np.sort(np.where(fine, x, np.inf), axis=0), fine.sum(0)


def ranks(finite: np.ndarray, q: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each column the ranks around quantile ``q``, and where it lies between them."""
    h = np.maximum(finite - 1, 0) * q
    low = np.floor(h).astype(np.int64)
    return low, np.ceil(h).astype(np.int64), h - low


def brackets(samples: np.ndarray, weights: np.ndarray, slack: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values between which the ranks ``low`` to ``high`` of each column lie for certain.

    A sample with weight w stands for itself and the w - 1 values before it; ``slack`` is the largest weight of a sample
    of each piece, summed over pieces.  At least the weights up to a sample are as small, and fewer than the weights
    before it and the slack are smaller.
    """
    order = np.argsort(samples, axis=0, kind="stable")
    values, upto = np.take_along_axis(samples, order, 0), np.cumsum(weights[order], axis=0)
    before = upto - weights[order]
    column = np.arange(samples.shape[1])
    k = (before + slack <= low).sum(0) - 1
    least = np.where(k >= 0, values[np.maximum(k, 0), column], -np.inf)
    k = (upto < high + 1).sum(0)
    most = np.where(k < len(values), values[np.minimum(k, len(values) - 1), column], np.inf)
    return least, most


def _keyed(names: list[str], key: tuple, rows: int, columns: dict) -> pa.Table:
    """A table with the key, or the first parts of it that have names, in each row."""
    return pa.table({n: pa.array([v.as_py()] * rows, v.type) for n, v in zip(names, key, strict=False)} | columns)


def wide_stats(df: DataFrame, keys: list[str], vector: str, points: dict[str, float] = QUANTILES, piece: int = PIECE) -> DataFrame:
    """keys, dim, mean, std (population), min, max, the quantiles ``points`` and count (of vectors that are finite throughout)."""
    own = [f"k{i}" for i in range(len(keys))]
    rows = df.filter(F.col(vector).isNotNull()).select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(vector).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    sizes = rows.groupBy(*own).agg(F.count("*").alias("n"), F.min(F.size("x")).alias("a"), F.max(F.size("x")).alias("z"), F.count_if(fine).alias("count"))
    sizes = stored(sizes, "sizes")
    top = sizes.agg(F.max("n").alias("n"), F.max("z").alias("z")).first()
    if not top["n"]:
        empty = sizes.select(*[F.col(o).alias(k) for k, o in zip(keys, own, strict=True)], F.lit(0).alias("dim"), *[F.lit(0.0).alias(c) for c in ("mean", "std", "min", "max", *points)], "count")
        return empty.limit(0)
    schema = ", ".join([*(f"{o} {t}" for o, t in rows.select(*own).dtypes)])
    hot = sizes.filter(F.col("n") > piece)
    largest = hot.agg(F.max("n").alias("n")).first()["n"]
    if largest is None:
        found = _whole(rows, own, schema, points, _width(top["n"], top["z"]))
    else:
        rows = beside(rows, hot.select(*own, F.ceil(F.col("n") / piece).cast("int").alias("pieces")), own)
        few = rows.filter("pieces is null").drop("pieces")
        many = rows.filter("pieces is not null").withColumn("piece", F.pmod(F.monotonically_increasing_id(), "pieces").cast("int")).drop("pieces")
        parts = -(-largest // piece)
        found = _whole(few, own, schema, points, _width(piece, top["z"])).unionByName(_pieced(many, own, schema, points, _width(max(2 * piece, parts * SAMPLES), top["z"])))
    out = with_columns_of(found, sizes.filter("a = z").select(*own, "count"), own)
    return out.select(*[F.col(o).alias(k) for k, o in zip(keys, own, strict=True)], "dim", "mean", "std", "min", "max", *points, "count")


def _width(rows: int, dims: int) -> int:
    """Dimensions of a block, so that a matrix of so many rows holds VALUES numbers at most."""
    return max(1, min(BLOCK, dims, VALUES // max(1, rows)))


def _blocks(rows: DataFrame, keep: list[str], width: int) -> DataFrame:
    """A row for each block of a vector."""
    last = F.floor((F.size("x") - 1) / width).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda b: F.struct(b.alias("block"), F.slice("x", b * width + 1, width).alias("x")))
    return rows.filter(F.size("x") > 0).select(*keep, F.explode(cut).alias("b")).select(*keep, "b.block", "b.x")


def _whole(rows: DataFrame, own: list[str], schema: str, points: dict[str, float], width: int) -> DataFrame:
    """Groups of which a block is one matrix."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x = matrix(table["x"])
        if x is None:
            return _keyed(own, key, 0, {"dim": pa.array([], pa.int32()), **{c: pa.array([], pa.float64()) for c in names}})
        n, mean, squares, low, high = moments(x)
        values, finite = sorted_finite(x)
        column, out = np.arange(x.shape[1]), []
        for q in points.values():
            a, z, share = ranks(finite, q)
            one, two = values[a, column], values[z, column]
            out.append(one + share * np.where(a == z, 0, two - one))
        with np.errstate(all="ignore"):
            made = [mean, np.sqrt(squares / n), low, high, *out]
        kept = np.flatnonzero(finite > 0)
        return _keyed(own, key, len(kept), {"dim": pa.array(kept + key[-1].as_py() * width, pa.int32()), **{c: pa.array(v[kept], pa.float64()) for c, v in zip(names, made, strict=True)}})

    names = ["mean", "std", "min", "max", *points]
    fields = ", ".join([*([schema] if schema else []), "dim int", _MOMENTS, *(f"`{q}` double" for q in points)])
    return _blocks(rows, own, width).groupBy(*own, "block").applyInArrow(run, fields)


def _pieced(rows: DataFrame, own: list[str], schema: str, points: dict[str, float], width: int) -> DataFrame:
    """Groups of many pieces: sketches, brackets, and the values within these."""
    lead = f"{schema}, " if schema else ""
    cells = _blocks(rows, [*own, "piece"], width)

    def sketch(key: tuple, table: pa.Table) -> pa.Table:
        x = matrix(table["x"])
        if x is None:
            return _keyed([*own, "piece", "block"], key, 0, {c: pa.array([], t) for c, t in (("n", pa.int64()), ("sums", pa.binary()), ("samples", pa.binary()))})
        values, finite = sorted_finite(x)
        at = -(-np.arange(1, SAMPLES + 1) * len(x) // SAMPLES) - 1
        sums = np.stack([*moments(x), finite]).astype(np.float64)
        return _keyed([*own, "piece", "block"], key, 1, {"n": pa.array([len(x)], pa.int64()), "sums": pa.array([sums.tobytes()], pa.binary()), "samples": pa.array([values[at].tobytes()], pa.binary())})

    sketches = cells.groupBy(*own, "piece", "block").applyInArrow(sketch, f"{lead}piece int, block int, n long, sums binary, samples binary")
    sketches = stored(sketches, "sketches")

    def bracket(key: tuple, table: pa.Table) -> pa.Table:
        size = table["n"].to_numpy()
        sums = np.stack([np.frombuffer(s.as_py(), np.float64).reshape(6, -1) for s in table["sums"]])
        samples = np.concatenate([np.frombuffer(s.as_py(), np.float64).reshape(SAMPLES, -1) for s in table["samples"]])
        at = -(-np.arange(SAMPLES + 1)[None] * size[:, None] // SAMPLES)
        weights, slack = np.diff(at, axis=1), 0
        slack = int(weights.max(1).sum())
        n, finite = sums[:, 0].sum(0), sums[:, 5].sum(0)
        with np.errstate(all="ignore"):
            mean = np.where(sums[:, 0] > 0, sums[:, 0] * sums[:, 1], 0).sum(0) / n
            squares = np.where(sums[:, 0] > 0, sums[:, 2] + sums[:, 0] * (sums[:, 1] - mean) ** 2, 0).sum(0)
            std = np.sqrt(squares / n)
        edges = []
        for q in points.values():
            low, high, share = ranks(finite, q)
            edges.append([*brackets(samples, weights.ravel(), slack, low, high), low, high, share])
        made = {"mean": mean, "std": std, "min": sums[:, 3].min(0), "max": sums[:, 4].max(0), "finite": finite}
        packed = {"edges": pa.array([np.array(edges, np.float64).tobytes()], pa.binary()), "sums": pa.array([np.stack(list(made.values())).tobytes()], pa.binary())}
        return _keyed([*own, "block"], key, 1, packed)

    found = stored(sketches.groupBy(*own, "block").applyInArrow(bracket, f"{lead}block int, edges binary, sums binary"), "brackets")
    # To each piece of a block its brackets: as many rows as there are sketches.
    sides = beside_blocks(sketches.select(*own, "piece", "block"), found, own)

    def within(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        x = matrix(left["x"]) if left.num_rows and right.num_rows else None
        if x is None:
            return _inside(key, [], [], [], [])
        values, _ = sorted_finite(x)
        edges = np.frombuffer(right["edges"][0].as_py(), np.float64).reshape(len(points), 5, -1)
        dims, nth, below, kept = [], [], [], []
        for p in range(len(points)):
            for d in range(values.shape[1]):
                a, z = np.searchsorted(values[:, d], edges[p, 0, d], "left"), np.searchsorted(values[:, d], edges[p, 1, d], "right")
                dims.append(d + key[-1].as_py() * width)
                nth.append(p)
                below.append(int(a))
                kept.append(values[a:z, d])
        return _inside(key, dims, nth, below, kept)

    def _inside(key: tuple, dims: list, nth: list, below: list, kept: list) -> pa.Table:
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(v) for v in kept])]).astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(kept) if kept else [], pa.float64()))
        return _keyed(own, key, len(dims), {"dim": pa.array(dims, pa.int32()), "point": pa.array(nth, pa.int32()), "below": pa.array(below, pa.int64()), "kept": lists})

    both = cells.groupBy(*own, "piece", "block").cogroup(sides.groupBy(*own, "piece", "block"))
    inside = both.applyInArrow(within, f"{lead}dim int, point int, below long, kept array<double>")
    inside = inside.groupBy(*own, "dim", "point").agg(F.sum("below").alias("below"), F.array_sort(F.flatten(F.collect_list("kept"))).alias("kept"))

    def unpacked(key: tuple, table: pa.Table) -> pa.Table:
        sums = np.frombuffer(table["sums"][0].as_py(), np.float64).reshape(5, -1)
        edges = np.frombuffer(table["edges"][0].as_py(), np.float64).reshape(len(points), 5, -1)
        dims = np.arange(sums.shape[1]) + key[-1].as_py() * width
        columns = {c: pa.array(v, pa.float64()) for c, v in zip(("mean", "std", "min", "max", "finite"), sums, strict=True)}
        for i, name in enumerate(("low", "high", "share")):
            flat = pa.array(edges[:, 2 + i].T.ravel(), pa.float64())
            columns[name] = pa.ListArray.from_arrays(pa.array(np.arange(len(dims) + 1, dtype=np.int32) * len(points)), flat)
        return _keyed(own, key, len(dims), {"dim": pa.array(dims, pa.int32()), **columns})

    fields = f"{lead}dim int, {_MOMENTS}, finite double, low array<double>, high array<double>, share array<double>"
    known = found.groupBy(*own, "block").applyInArrow(unpacked, fields).filter("finite > 0")
    joined = with_columns_of(inside, known, [*own, "dim"])
    at = lambda c: F.get("kept", (F.get(c, F.col("point")) - F.col("below")).cast("int"))
    value = at("low") + F.get("share", F.col("point")) * (at("high") - at("low"))
    picked = [F.max(F.when(F.col("point") == i, value)).alias(q) for i, q in enumerate(points)]
    return joined.groupBy(*own, "dim").agg(*[F.first(c).alias(c) for c in ("mean", "std", "min", "max")], *picked)


def beside_blocks(pieces: DataFrame, found: DataFrame, own: list[str]) -> DataFrame:
    """The brackets of each block for all its pieces, joined by shuffle: there is a row for each piece and block."""
    keys = [*own, "block"]
    side = found.select(*keys, "edges").withColumnsRenamed({k: f"_s_{k}" for k in keys})
    return pieces.join(side, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys]).drop(*[f"_s_{k}" for k in keys])
