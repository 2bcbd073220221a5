"""Poses as column expressions: quaternions (x, y, z, w), rotation vectors, relative motion.

All rotations go through quaternions, whose half angle comes from atan2: no branch is needed near 0 or pi.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinetable.functions.values import col, norm

TINY = 1e-12


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression over a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def unit(q: Column | str) -> Column:
    """Of length one; null for a quaternion without length."""
    return let(col(q), lambda p: let(norm(p), lambda n: F.when(n > TINY, F.transform(p, lambda x: x.cast("double") / n))))


def conjugate(q: Column) -> Column:
    return F.array(-q[0], -q[1], -q[2], q[3])


def times(p: Column, q: Column) -> Column:
    return F.array(
        p[3] * q[0] + p[0] * q[3] + p[1] * q[2] - p[2] * q[1],
        p[3] * q[1] - p[0] * q[2] + p[1] * q[3] + p[2] * q[0],
        p[3] * q[2] + p[0] * q[1] - p[1] * q[0] + p[2] * q[3],
        p[3] * q[3] - p[0] * q[0] - p[1] * q[1] - p[2] * q[2],
    )


def rotate(q: Column, v: Column) -> Column:
    """v turned by the unit quaternion q."""
    return let(times(q, F.array(v[0], v[1], v[2], F.lit(0.0))), lambda t: F.slice(times(t, conjugate(q)), 1, 3))


def matrix(q: Column | str) -> Column:
    """Row-major 3 x 3 rotation matrix."""

    def cells(u: Column) -> Column:
        x, y, z, w = (u[i] for i in range(4))
        rows = ((1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)), (2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)), (2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)))
        return F.when(u.isNotNull(), F.array(*[c for row in rows for c in row]))

    return let(unit(q), cells)


def rotation_vector(q: Column) -> Column:
    """Axis times angle (0 to pi) of a unit quaternion."""

    def scaled(p: Column) -> Column:
        sign = F.when(p[3] < 0, -1.0).otherwise(1.0)
        scale = let(norm(F.slice(p, 1, 3)), lambda n: F.when(n > TINY, sign * 2 * F.atan2(n, F.abs(p[3])) / n).otherwise(2.0 * sign))
        return let(scale, lambda k: F.transform(F.slice(p, 1, 3), lambda x: x * k))

    return let(q, scaled)


def turn_between(p: Column, q: Column) -> Column:
    """The angle between two orientations, whatever their signs."""
    w = let(unit(p), lambda a: let(unit(q), lambda b: F.abs(a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3])))
    return 2 * F.acos(F.least(w, F.lit(1.0)))


def position(pose: Column) -> Column:
    return F.transform(F.slice(pose, 1, 3), lambda x: x.cast("double"))


def orientation(pose: Column) -> Column:
    return F.slice(pose, 4, 4)


def is_valid(pose: Column | str) -> Column:
    """Seven values whose quaternion has a length: all zeros stand for no pose."""
    p = col(pose)
    square = F.aggregate(orientation(p), F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return F.coalesce((F.size(p) >= 7) & (square > 1e-12), F.lit(False))


def is_displayable(pose: Column | str) -> Column:
    """Finite, with a quaternion of about length one."""
    p = col(pose)
    fine = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(p) >= 7) & fine & norm(orientation(p)).between(0.5, 1.5), F.lit(False))


def local_motion(a: Column, b: Column) -> Column:
    """Six values: how pose b lies in the frame of pose a, as translation and rotation vector."""
    def moved(back: Column) -> Column:
        step = let(F.zip_with(position(b), position(a), lambda x, y: x - y), lambda d: rotate(back, d))
        return F.concat(step, let(unit(orientation(b)), lambda q: rotation_vector(times(back, q))))

    return let(let(unit(orientation(a)), conjugate), moved)


def relabelled(pose: Column, axes: tuple[int, int, int], signs: tuple[int, int, int]) -> Column:
    """A pose with its axes renamed, for position and the quaternion's vector part."""
    p = [pose[a] * s for a, s in zip(axes, signs, strict=True)]
    q = [pose[3 + a] * s for a, s in zip(axes, signs, strict=True)]
    return F.array(*p, *q, pose[6])
