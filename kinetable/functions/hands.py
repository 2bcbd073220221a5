"""Hands as flat arrays of keypoints, and what is told about them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinetable.functions.values import all_finite, col

POINTS = 21
#: Gestures by their number.
GESTURES = ("fist", "open", "point", "victory", "thumb_up", "ok")


def points(flat: Column | str, size: int = 3, digits: int | None = None) -> Column:
    """A flat array as points of ``size`` values; what isn't finite is null."""
    a = col(flat)

    def value(x: Column) -> Column:
        fine = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        return fine if digits is None else F.bround(fine, digits)

    return F.when(F.size(a) >= POINTS * size, F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda i: F.transform(F.slice(a, i * size + 1, size), value)))


def is_hand(flat: Column | str, present: Column | str) -> Column:
    """Of the right length, finite throughout, and said to be there."""
    a = col(flat)
    return F.coalesce((F.size(a) == POINTS * 3) & all_finite(a) & col(present), F.lit(False))


def gesture(number: Column | str) -> Column:
    """The name of a gesture; nothing for null, NaN, negative or unknown numbers."""
    n = col(number).cast("double")
    known = n.isNotNull() & ~F.isnan(n) & (n >= 0)
    return F.coalesce(F.get(F.array(*map(F.lit, GESTURES)), F.when(known, n.cast("int"))), F.lit(""))


def columns_of(prefix: str, side: str, suffix: str = "") -> dict[str, str]:
    """The names under which a hand's columns are exported."""
    return {k: f"observation.{prefix}hand_{side}_{k}{suffix}" for k in ("keypoints", "confidence", "gesture", "handedness", "source")}
