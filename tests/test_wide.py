import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.operators import wide
from kinetable.operators.stats import QUANTILES


def by_hand(rows):
    """(key, dim) -> mean, std, min, max, quantiles, count, with numpy."""
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append([math.nan if x is None else x for x in v])
    out = {}
    for k, own in groups.items():
        if len({len(v) for v in own}) > 1 or not own[0]:
            continue
        x = np.array(own, float)
        for d in range(x.shape[1]):
            c = x[:, d]
            fine, there = c[np.isfinite(c)], c[~np.isnan(c)]
            if len(fine):
                with np.errstate(all="ignore"):
                    m = [there.mean(), there.std(), there.min(), there.max()]
                out[k, d] = [*m, *np.quantile(fine, list(QUANTILES.values())), int(np.isfinite(x).all(1).sum())]
    return out


def cases():
    rng = np.random.default_rng(6)
    rows = [("hot", [float(x) for x in rng.integers(0, 9, 5)] + [float(rng.normal()), 7.0]) for _ in range(1500)]
    rows += [(None, [float(x) for x in rng.normal(size=7)]) for _ in range(300)] + [("small", [float(x) for x in rng.normal(size=7)]) for _ in range(9)]
    rows += [("odd", [math.nan, math.inf, None, 1.0, -math.inf, math.nan, 2.0]), ("odd", [1.0, 2.0, 3.0, math.nan, 5.0, math.nan, 7.0]), ("none", None), ("ragged", [1.0]), ("ragged", [1.0, 2.0]), ("empty", [])]
    rows += [("hot", [math.nan, math.inf, None, -math.inf, 1.0, math.nan, 7.0])] * 40 + [("hot", [3.0] * 7)] * 700
    return rows


@pytest.mark.parametrize("piece", [100, 2000, 1 << 16])
def test_equals_numpy(spark, piece, monkeypatch):
    rows = cases()
    if piece == 100:
        monkeypatch.setattr(wide, "VALUES", 1 << 11)  # several blocks of dimensions
    got = {(r["k"], r["dim"]): r for r in wide.wide_stats(spark.createDataFrame(rows, "k string, v array<double>").repartition(4), ["k"], "v", piece=piece).collect()}
    want = by_hand(rows)
    assert got.keys() == want.keys()
    for at, own in want.items():
        for name, v in zip(("mean", "std", "min", "max", *QUANTILES, "count"), own, strict=True):
            assert got[at][name] == pytest.approx(v, rel=1e-9, abs=1e-12, nan_ok=True), (at, name)


def test_without_keys_and_empty(spark):
    df = spark.createDataFrame([([float(i), -2.0 * i],) for i in range(500)], "v array<float>")
    got = {r["dim"]: r for r in wide.wide_stats(df, [], "v", piece=50).collect()}
    assert got[0]["q50"] == 249.5 and got[1]["q01"] == pytest.approx(np.quantile(-2.0 * np.arange(500), 0.01)) and got[1]["count"] == 500
    assert wide.wide_stats(df.limit(0), [], "v").collect() == [] and wide.wide_stats(df.limit(0).withColumn("k", F.lit(1)), ["k"], "v").columns[:2] == ["k", "dim"]


def test_very_wide_vectors(spark):
    """As many dimensions as a force matrix has, without a row for each value."""
    n, dims = 12, 187_500
    value = lambda i: F.pmod(F.hash(i, F.col("id")), F.lit(1000)) / 8.0
    df = spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), value).alias("v"))
    x = np.array([r["v"] for r in df.orderBy("id").collect()])
    got = wide.wide_stats(df.repartition(3), [], "v").orderBy("dim").toPandas()
    assert len(got) == dims
    for name, q in QUANTILES.items():
        assert np.allclose(got[name], np.quantile(x, q, axis=0))
    assert np.allclose(got["mean"], x.mean(0)) and np.allclose(got["std"], x.std(0)) and (got["max"] == x.max(0)).all()


def test_brackets_hold_the_ranks():
    rng = np.random.default_rng(1)
    for _ in range(50):
        pieces = [np.sort(rng.integers(0, 60, (int(rng.integers(1, 900)), 3)).astype(float), axis=0) for _ in range(int(rng.integers(1, 6)))]
        whole = np.sort(np.concatenate(pieces), axis=0)
        samples, weights, slack = [], [], 0
        for p in pieces:
            at = -(-np.arange(wide.SAMPLES + 1) * len(p) // wide.SAMPLES)
            samples.append(p[at[1:] - 1])
            weights.append(np.diff(at))
            slack += int(weights[-1].max())
        for q in (0.0, 0.01, 0.5, 0.9, 1.0):
            low, high, _ = wide.ranks(np.full(3, len(whole)), q)
            a, z = wide.brackets(np.concatenate(samples), np.concatenate(weights), slack, low, high)
            assert (a <= whole[low, range(3)]).all() and (z >= whole[high, range(3)]).all()
