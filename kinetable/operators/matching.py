"""One-to-one matching: cheapest pairs first, sources claimed by kinds of inputs, and hands kept in slots from frame to frame."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.operators.tracks import scanned
from kinetable.sources.datasets import stored


@dataclass(frozen=True)
class Claim:
    """What sources an input kind takes: those named by its keys (or parts of one another), else the first that holds one of
    ``words`` and none of ``without``; all of those if ``every``."""

    kind: str
    keys: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    without: tuple[str, ...] = ()
    every: bool = False


def mutual_matches(pairs: DataFrame, by: list[str], left: str, right: str, cost: str, rounds: int = 1000) -> DataFrame:
    """Of candidate pairs those that greedy matching takes: the cheapest first, each side once; of equal costs the smaller
    left, then the smaller right.  Pairs without a cost are none.

    In each round all pairs are taken that are the first of both their sides, which greedy matching would take as well,
    whatever it takes before; their sides are then left out.  So a round is two windows and a join, for all keys at once,
    and rounds are as many as pairs wait for one another.
    """
    free = stored(pairs.filter(F.col(cost).isNotNull() & ~F.isnan(F.col(cost).cast("double"))).select(*by, left, right, cost).distinct(), "pairs")
    found: DataFrame | None = None
    for _ in range(rounds):
        of_left = F.row_number().over(Window.partitionBy(*by, left).orderBy(cost, right))
        of_right = F.row_number().over(Window.partitionBy(*by, right).orderBy(cost, left))
        taken = free.withColumn("_l", of_left).withColumn("_r", of_right).filter("_l = 1 and _r = 1").drop("_l", "_r")
        taken = stored(taken, "matches")
        found = taken if found is None else found.union(taken)
        rest = free
        for side in (left, right):
            keys = [*by, side]
            gone = taken.select(*[F.col(k).alias(f"_g_{k}") for k in keys])
            rest = rest.join(gone, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys], "left_anti")
        free = stored(rest, "pairs")
        if free.isEmpty():
            return found
    raise RuntimeError(f"matching did not end in {rounds} rounds")


def claimed_sources(df: DataFrame, by: list[str], source: str, claims: Sequence[Claim]) -> DataFrame:
    """by, kind and sources: what each kind of input takes of the sources of each key, in small letters, in the order of the
    claims; a source goes to one kind only, and kinds that get none have an empty list.

    A key's sources are one list, and each claim an expression over what is left of it: one grouping, no join.
    """
    rows = df.filter(F.col(source).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_set(F.lower(source))).alias("_free"))
    empty = F.array().cast("array<string>")
    for n, c in enumerate(claims):
        own: Column = empty
        for key in (k.lower() for k in c.keys):
            own = F.concat(own, F.slice(F.filter("_free", _named_by(own, key)), 1, 1))
        rows = rows.withColumn(f"_own{n}", own)
        if c.words or c.without:
            fits = F.filter("_free", _worded(c))
            rows = rows.withColumn(f"_own{n}", F.when(F.size(f"_own{n}") == 0, fits if c.every else F.slice(fits, 1, 1)).otherwise(F.col(f"_own{n}")))
        elif c.every:
            rows = rows.withColumn(f"_own{n}", F.when(F.size(f"_own{n}") == 0, F.col("_free")).otherwise(F.col(f"_own{n}")))
        rows = rows.withColumn("_free", F.array_except("_free", f"_own{n}"))
    kinds = F.array(*[F.struct(F.lit(c.kind).alias("kind"), F.col(f"_own{n}").alias("sources")) for n, c in enumerate(claims)])
    return rows.select(*by, F.explode(kinds).alias("_k")).select(*by, "_k.kind", "_k.sources")


def _named_by(own: Column, key: str) -> Callable[[Column], Column]:
    return lambda s: ~F.array_contains(own, s) & (s.contains(key) | F.lit(key).contains(s))


def _worded(c: Claim) -> Callable[[Column], Column]:
    return lambda s: _any(s, c.words, True) & ~_any(s, c.without, False)


def _any(s: Column, words: Sequence[str], if_none: bool) -> Column:
    out = F.lit(if_none) if not words else F.lit(False)
    for w in words:
        out = out | s.contains(w)
    return out


#: How far a hand may be from where its slot is predicted; wrists nearer than this may have been swapped, and are if that
#: is better by more than the gain.
GATE, NEAR, GAIN = 0.15, 0.10, 0.005
#: The slots that labels stand for.
SIDES = {"left": 0, "right": 1}


@dataclass
class Slot:
    """A hand that is followed: its label, place and speed, the frame seen last, and frames since."""

    label: str = ""
    place: np.ndarray | None = None
    speed: np.ndarray | None = None
    seen: int = 0
    lost: int = 0

    def guess(self, frame: int, most: int) -> np.ndarray | None:
        return None if self.place is None or self.lost > most else self.place + self.speed * max(0, frame - self.seen)

    def saw(self, label: str, place: np.ndarray, frame: int, most: int, alpha: float, beta: float) -> None:
        ahead = self.guess(frame, most)
        # So too where a lost hand comes back from afar: that tells nothing of its speed.
        far = ahead is not None and not np.linalg.norm(place - ahead) <= GATE
        anew = far or ahead is None or bool(label and self.label and label != self.label)
        self.label = label or self.label
        if anew:
            place = place if np.isfinite(place).all() else ahead
            self.place, self.speed = place, np.zeros(3) if place is not None else None
        else:
            now = ahead + alpha * (place - ahead)
            self.speed = self.speed + beta * ((now - self.place) / max(1e-3, frame - self.seen) - self.speed)
            self.place = now
        self.seen, self.lost = frame, 0


def assigned(slots: list[Slot], frame: int, labels: list[str], places: np.ndarray, wrists: np.ndarray, most: int) -> dict[int, int]:
    """Hand to slot.  Hands are matched by label first, where it names one slot only and the place agrees with that, or the slot has
    lost its hand, as then its prediction drifts and the label is all there is; then by place, the nearest first, where
    labels don't differ; then into slots that were never seen, by what a label stands for."""
    n = range(len(labels))
    guesses = [s.guess(frame, most) for s in slots]
    cost = np.full((len(labels), 2), np.inf)
    for s, g in enumerate(guesses):
        if g is not None:
            cost[:, s] = np.nan_to_num(np.linalg.norm(places - g, axis=1), nan=np.inf)
    out: dict[int, int] = {}
    free = lambda: [s for s in (0, 1) if s not in out.values()]
    if all(s.label == "" for s in slots) and all(g is None for g in guesses):
        for s in (0, 1):
            out |= next(({i: s} for i in n if i not in out and SIDES.get(labels[i]) == s), {})
        for i in n:
            if i not in out and free():
                out[i] = free()[0]
        return out
    for fits in (lambda i, s: guesses[s] is not None and cost[i, s] <= GATE, lambda i, s: slots[s].lost >= 1):
        for i in n:
            if labels[i] and i not in out:
                named = [s for s in free() if slots[s].label == labels[i]]
                if len(named) == 1 and fits(i, named[0]):
                    out[i] = named[0]
    agrees = lambda i, s: "" in (labels[i], slots[s].label) or labels[i] == slots[s].label
    near = sorted((cost[i, s], i, s) for i in n for s in (0, 1) if guesses[s] is not None and agrees(i, s) and cost[i, s] <= GATE)
    for _, i, s in near:
        if i not in out and s in free():
            out[i] = s
    if len(out) == 2:
        (a, _), (b, _) = sorted(out.items(), key=lambda p: p[1])
        if np.linalg.norm(wrists[a] - wrists[b]) < NEAR:
            now, other = cost[a, 0] + cost[b, 1], cost[b, 0] + cost[a, 1]
            if agrees(b, 0) and agrees(a, 1) and (not (agrees(a, 0) and agrees(b, 1)) or other < now - GAIN):
                out = {a: 1, b: 0}
    for i in n:
        dead = [s for s in free() if guesses[s] is None]
        if i in out or not dead:
            continue
        if labels[i] in SIDES and SIDES[labels[i]] in dead:
            out[i] = SIDES[labels[i]]
        elif not labels[i] and len(dead) == 1:
            out[i] = dead[0]
    return out


def mono_slots(df: DataFrame, by: list[str], index: str, hand: str, label: str, place: str, wrist: str, most: int = 15, alpha: float = 0.5, beta: float = 0.1) -> DataFrame:
    """Hands that one camera sees in each frame (place and wrist: arrays of three, null or NaN where unknown) in two slots
    that last: by, index, hand, slot and slot_label, of the hands that got one.

    Each frame's hands are one row, and the two slots are all that is carried along a stream (``assigned`` has the rules).
    Labels count in small letters, null as none.
    """
    own = F.struct(F.col(hand).alias("hand"), F.coalesce(F.lower(label), F.lit("")).alias("label"), F.col(place).alias("place"), F.col(wrist).alias("wrist"))
    frames = df.groupBy(*by, index).agg(F.array_sort(F.collect_list(own), lambda a, b: F.when(a["hand"] < b["hand"], -1).otherwise(1)).alias("_h"))
    point = lambda v: np.array([np.nan] * 3 if v is None else [np.nan if x is None else x for x in v], float)

    def step(state, pdf: pd.DataFrame):
        slots, rows = state or [Slot(), Slot()], []
        for frame, found in zip(pdf[index].tolist(), pdf["_h"], strict=True):
            labels = [h["label"] for h in found]
            places, wrists = (np.array([point(h[k]) for h in found]) for k in ("place", "wrist"))
            taken = assigned(slots, frame, labels, places, wrists, most)
            for i, s in taken.items():
                slots[s].saw(labels[i], places[i], frame, most, alpha, beta)
                rows.append((frame, found[i]["hand"], s, slots[s].label))
            for s in {0, 1} - {*taken.values()}:
                slots[s].lost += 1
        return slots, pd.DataFrame(rows, columns=[index, hand, "slot", "slot_label"])

    kinds = dict(df.dtypes)
    return scanned(frames, by, index, step, f"`{index}` {kinds[index]}, `{hand}` {kinds[hand]}, slot int, slot_label string")
