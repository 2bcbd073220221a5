import numpy as np
import pytest

from kinetable.llm import vectors


def brute_force(rows, least=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    good = [(i, v / np.linalg.norm(v)) for i, v in good]
    n, parent = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            if len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= least:
                n[good[a][0]] += 1
                n[good[b][0]] += 1
                p, q = find(good[a][0]), find(good[b][0])
                if p is not q:
                    parent[max(p, q)] = min(p, q)
    return {i: (n[i], find(i)) for i in n}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    out, n = [], 0
    for g in range(40):
        base = rng.normal(size=16)
        for _ in range((1, 2, 3, 120)[g % 4] if g < 8 else 3):
            out.append((n, (base + rng.normal(size=16) * rng.choice((0.0, 0.05, 0.2))).astype(np.float32).tolist()))
            n += 1
    out += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0] * 5), (1004, [None] * 16), (1005, out[0][1]), (1006, [2 * x for x in out[0][1]]), (1007, [1.0, 1.0, 0.0, 0.0, 0.0]), (1008, [1.0, 0.1, 0.0, 0.0, 0.1]), (1009, [1.0, 2.0])]
    return out


@pytest.mark.parametrize("block", [7, 50])
def test_links_and_components_against_brute_force(spark, rows, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as label", "2 as v", "'k' as key")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect()}
    want = brute_force(rows)
    assert got == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in vectors.near_duplicates(df.limit(5)).collect())


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df).collect())
    assert got == [(-1, 0, None, True), (4, 0, 4, True)]
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_recall_of_the_graph_alone(spark, rows):
    good = [(i, v) for i, v in rows if i < 1000]
    df = spark.createDataFrame(good, "v long, vector array<float>")
    assert vectors.audited(vectors.neighbour_graph(df), df, 0.95, 2000) >= 0.9


def in_groups(rng, near, cross, n, size=64):
    """Two groups of n vectors at about ``near`` among themselves, ``cross`` with the other group."""
    axes = np.linalg.qr(rng.normal(size=(size, size)))[0]
    turn = np.arccos(cross / near) / 2
    own = rng.normal(size=(2 * n, size - 2)) @ axes[2:]
    own /= np.linalg.norm(own, axis=1)[:, None]
    centre = np.cos(turn) * axes[0] + np.repeat([-1, 1], n)[:, None] * np.sin(turn) * axes[1]
    return np.sqrt(near) * centre + np.sqrt(1 - near) * own


def test_links_between_dense_groups_are_whole(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([in_groups(rng, 0.99, 0.955, 200), rng.normal(size=(600, 64))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    n = (x @ x.T >= 0.95).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect()}
    assert n[:400].min() > 380 and got == {i: (n[i], 0 if i < 400 else i) for i in range(1000)}


def test_each_length_is_a_set_of_its_own(spark):
    rows = [(i, [1.0, 0.0, 0.1 * i]) for i in range(3)] + [(10 + i, [1.0, 0.01 * i]) for i in range(2)] + [(20, [1.0]), (21, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df).collect()}
    assert got == {0: (2, 0, True), 1: (2, 0, False), 2: (2, 0, False), 10: (1, 10, True), 11: (1, 10, False), 20: (0, 20, True), 21: (0, 21, True)}


@pytest.mark.parametrize("scale", [1e200, 1e-200, 5e-310, 1.0])
def test_vectors_of_any_magnitude_are_compared(spark, scale):
    rows = [(1, [scale, 0.0]), (2, [scale, scale / 128]), (3, [-scale, 0.0]), (4, [0.0, scale]), (5, [1.0, 1.0 / 128])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (0, 4), 5: (2, 1)}


def test_tight_groups_are_counted_without_comparing(spark, monkeypatch):
    """Copies that lie within half the angle of a link: blocks of them are sure, no pair of theirs is compared."""
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(3, 32))
    x = np.concatenate([b + rng.normal(size=(90, 32)) * 0.02 for b in base] + [rng.normal(size=(40, 32))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    pairs = []
    monkeypatch.setattr(vectors, "stored", lambda df, name, f=vectors.stored: pairs.append(f(df, name)) or pairs[-1] if name == "pairs" else f(df, name))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect()}
    assert got == brute_force([(i, v.tolist()) for i, v in enumerate(x)])
    assert pairs[0].filter("all").count() > 0 and pairs[0].filter("not all").count() == 0


def test_low_recall_leads_to_all_pairs(spark, rows, monkeypatch):
    monkeypatch.setattr(vectors, "recall_of", lambda *a: 0.5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect()} == brute_force(rows)
