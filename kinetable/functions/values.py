"""Column expressions for numbers, arrays, names and clocks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
#: Nanoseconds of a unit.
UNITS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def not_nan(c: Column | str) -> Column:
    """Null in place of NaN, which Spark's aggregates would otherwise return."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def finite(c: Column | str) -> Column:
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != INF), c)


def first_finite(*columns: Column | str) -> Column:
    """The first of these that is neither null nor NaN nor infinite."""
    return F.coalesce(*[finite(c) for c in columns])


def clamp(c: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.least(col(c), F.lit(high)), F.lit(low))


def percent(c: Column | str) -> Column:
    """0 to 100; null if not finite."""
    return clamp(finite(c), 0.0, 100.0)


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col(ts).cast("timestamp_ntz"))


def to_ns(c: Column | str, unit: str) -> Column:
    return F.rint(col(c).cast("double") * UNITS[unit]).cast("long") if unit != "ns" else col(c).cast("long")


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def minus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x.cast("double") - y)


def all_finite(a: Column | str) -> Column:
    return F.forall(col(a), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != INF))


def angle_deg(u: Column | str, v: Column | str) -> Column:
    """Between two vectors, null if one has no length."""
    n = norm(u) * norm(v)
    return F.when(n > 1e-12, F.degrees(F.acos(clamp(dot(u, v) / n, -1.0, 1.0))))


def joint_angle(a: Column, vertex: Column, b: Column) -> Column:
    return angle_deg(minus(a, vertex), minus(b, vertex))


def extension_mask(angles: Sequence[Column], least: float = 160.0) -> Column:
    """Bit i is set if the i-th joint is stretched."""
    out = F.lit(0)
    for i, a in enumerate(angles):
        out = out.bitwiseOR(F.when(a >= least, 1 << i).otherwise(0))
    return out


def back_projected(u: Column, v: Column, z: Column, fx: float, fy: float, cx: float, cy: float) -> Column:
    """The point in space of a pixel at depth z."""
    return F.when(z > 0, F.array((u - cx) * z / fx, (v - cy) * z / fy, z))


def fitted(a: Column | str, width: int) -> Column:
    """The first ``width`` values, an empty array for null."""
    return F.coalesce(F.slice(col(a), 1, width), F.array().cast("array<double>"))


def grid(a: Column | str, columns: int) -> Column:
    """A flat array as rows of ``columns`` values."""
    a = col(a)
    return F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / columns).cast("int")), lambda i: F.slice(a, i * columns + 1, columns)))


def padded(a: Column | str, length: Column | int, fill: Column) -> Column:
    a = F.coalesce(col(a), F.array().cast("array<double>"))
    n = F.lit(length) if isinstance(length, int) else length
    return F.concat(a, F.array_repeat(fill, F.greatest(n - F.size(a), F.lit(0)).cast("int")))


def chunk_of(index: Column | str, size: int = 1000, one_based: bool = False) -> Column:
    return F.floor((col(index) - int(one_based)) / size).cast("long")


def episode_name(index: Column | str) -> Column:
    """Six digits, or all of a longer number."""
    digits = col(index).cast("string")
    return F.concat(F.lit("episode_"), F.lpad(digits, F.greatest(F.length(digits), F.lit(6)), F.lit("0")))


def episode_index(name: Column | str) -> Column:
    found = F.regexp_extract(col(name), r"_(\d{6,})(?:\.[A-Za-z0-9]+)?$", 1)
    return F.when(found != "", found.cast("long"))


def token(c: Column | str) -> Column:
    """A name with all but letters and digits as single underscores, in lower case."""
    return F.trim(F.lower(F.regexp_replace(col(c), r"[^0-9A-Za-z]+", "_")), F.lit("_"))


def unwrapped_step(d: Column, bits: int = 32) -> Column:
    """A step between two readings of a counter of so many bits that may have wrapped."""
    span = float(1 << bits)
    return F.when(d < -span / 2, d + F.lit(1 << bits)).otherwise(d)


def clock_class(low: Column, high: Column) -> Column:
    """What a clock's range tells: a signed 32-bit cut, an epoch in nanoseconds, or a counter since start."""
    return (
        F.when((low >= -(1 << 31)) & (high < (1 << 31)) & (low < 0), "truncated_32")
        .when(low >= 10**18, "epoch_ns")
        .when(low >= 0, "device_counter")
        .otherwise("unknown")
    )


# Fixed values of the depth format: millimetres of code 0 and of the last code.
DEPTH_MIN_MM, DEPTH_MAX_MM, DEPTH_CODES = 100.0, 5000.0, 4095
_PER_LOG = DEPTH_CODES / math.log(DEPTH_MAX_MM / DEPTH_MIN_MM)


def depth_code(mm: Column | str) -> Column:
    """12-bit logarithmic code of a depth; 0 for no depth and for the nearest."""
    mm = col(mm).cast("double")
    return F.when(mm > 0, clamp(F.rint((F.ln(mm) - math.log(DEPTH_MIN_MM)) * _PER_LOG), 0, DEPTH_CODES)).otherwise(0).cast("int")


def depth_mm(code: Column | str) -> Column:
    return F.rint(F.exp(math.log(DEPTH_MIN_MM) + col(code) / _PER_LOG)).cast("int")


def worst(status: Column | str, order: Sequence[str]) -> Column:
    """An aggregate: of the known statuses the one that comes first in ``order``, else the last of ``order``."""
    rank = F.array_position(F.array(*map(F.lit, order)), col(status))
    return F.coalesce(F.element_at(F.array(*map(F.lit, order)), F.min(F.when(rank > 0, rank)).cast("int")), F.lit(order[-1]))


def lists_of(flat: Column | str, offsets: Column | str) -> Column:
    """Lists from their values one after another and where each begins, with the end of the last."""
    a, at = col(flat), col(offsets)
    return F.transform(F.sequence(F.lit(0), F.size(at) - 2), lambda i: F.slice(a, F.get(at, i) + 1, F.get(at, i + 1) - F.get(at, i)))
