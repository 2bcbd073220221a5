import random

import duckdb
import numpy as np
import pytest

from kinetable.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def by_hand(rows, parts=codes.PARTS, entries=codes.ENTRIES, rounds=codes.ROUNDS):
    """Python's integers throughout; rows of one length."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[int(np.floor(x * 256.0)) for x in v] for _, v, _ in kept]
    at = codes.borders(len(ints[0])) if ints else [0] * (parts + 1)
    cut = [[tuple(v[a:z]) for v in ints] for a, z in zip(at, at[1:])]
    books = [list(own[:entries]) for own in cut]

    def nearest(x, book):
        return min((sum((p - q) ** 2 for p, q in zip(x, c)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p, own in enumerate(cut):
            of = [nearest(x, books[p])[1] for x in own]
            for k in range(len(books[p])):
                mine = [x for x, e in zip(own, of) if e == k]
                if mine:
                    books[p][k] = tuple(sum(c) // len(mine) for c in zip(*mine))
    found = [[nearest(x, book) for x in own] for own, book in zip(cut, books)]
    out = [(r[0], "".join(f"{f[n][1]:02x}" for f in found), sum(f[n][0] for f in found), r[2]) for n, r in enumerate(kept)]
    sums = {}
    for _, _, e, lab in out:
        sums[lab] = sums.get(lab, 0) + e
    return sorted(((i, c, e, sums[lab]) for i, c, e, lab in out), key=str), books


def vectors(n, length, seed=3, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, length)) * spread
    return [(int(i), [float(x) for x in centres[rng.integers(9)] + rng.normal(size=length) * 0.1], int(rng.integers(3)) if i % 7 else None) for i in rng.permutation(n)]


def got_of(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as code", "2 as error", "3 as length", "4 as c0", "5 as v").repartition(5)
    out = codes.compressed(df).collect()
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in out), key=str), {r["codebooks_sha256"] for r in out}


@pytest.mark.parametrize("length", [64, 32, 16, 37, 5])
def test_equals_brute_force(spark, length):
    rows = vectors(200, length) + [(900, None, 1), (901, [None] * length, 1), (902, [float("nan")] * length, 1), (903, [float("inf")] * length, 1), (904, [0.0] * length, 1), (904, [0.0] * length, 1)]
    got, sha = got_of(spark, rows)
    want, books = by_hand(rows)
    assert got == want and sha == {codes.digest([np.array(b, object) for b in books])}


def test_equals_its_sql(spark):
    rows = vectors(300, 64) + [(900, None, 1), (901, [float("nan")] * 64, 1), (902, [-5e-3] * 64, None)]
    c = duckdb.connect()
    c.execute("create table embeddings(vec_id bigint, embedding double[], label int)")
    c.executemany("insert into embeddings values (?, ?, ?)", rows)
    found = c.execute(codes.SQL)
    names = [d[0] for d in found.description]
    want = [dict(zip(names, r)) for r in found.fetchall()]
    got, sha = got_of(spark, rows)
    assert got == sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in want), key=str) and sha == {r["codebooks_sha256"] for r in want}


def test_few_rows_ties_and_large_numbers(spark):
    for rows in (
        [(1, [0.5] * 16, None)],
        [(i, [float(i % 3)] * 16, i % 2) for i in range(100)],
        [(i, [1e9 * (i % 5), -3e12, 1e-9, 7.0] * 4, 0) for i in range(80)],
        [(i, [float(x) for x in np.random.default_rng(i).normal(size=16) * 10.0 ** (i % 9)], 0) for i in range(150)],
        [(None, [1.0] * 16, 0), (2, [2.0] * 16, 0), (2, [1.5] * 16, 0)],
    ):
        got, sha = got_of(spark, rows)
        want, books = by_hand(rows)
        fits = [(i, c, e if e < 1 << 63 else None, s if s < 1 << 63 else None) for i, c, e, s in want]
        assert got == sorted(fits, key=str) and sha == {codes.digest([np.array(b, object) for b in books])}


def test_floats_of_any_size(spark):
    rows = [(i, [float(np.float32(3e38)) * (-1) ** i, 1.0, 0.0, float(i)] * 4, 0) for i in range(70)]
    got, sha = got_of(spark, rows)
    want, books = by_hand(rows)
    assert [(i, c) for i, c, *_ in got] == [(i, c) for i, c, *_ in want] and sha == {codes.digest([np.array(b, object) for b in books])}


def test_lengths_are_sets_of_their_own(spark):
    a, b = vectors(90, 32), [(1000 + i, v, None) for i, v, _ in vectors(90, 48, seed=8)]
    got, _ = got_of(spark, a + b + [(5000, [], 2)])
    alone = [[r[:3] for r in by_hand(rows)[0]] for rows in (a, b)]
    assert sorted((r[:3] for r in got), key=str) == sorted([*alone[0], *alone[1], (5000, "00" * 16, 0)], key=str)
    with pytest.raises(ValueError):
        codes.codebooks(spark.createDataFrame([(i, [1.0] * i, 0) for i in range(codes.LENGTHS + 2)], SCHEMA))


def test_empty_table_and_one_without_labels(spark):
    assert got_of(spark, []) == ([], set())
    df = spark.createDataFrame([(1, [1.0] * 16), (2, [2.0] * 16)], "vec_id long, embedding array<float>")
    assert {r["label_error"] for r in codes.compressed(df).collect()} == {0}


def test_partial_distances_drop_entries_and_no_nearest():
    rng = np.random.default_rng(2)
    for dtype in (np.int64, object):
        for k, d in ((64, 16), (64, 4), (5, 1), (1, 3)):
            book = (rng.normal(size=(k, d)) * 300 * np.linspace(0.1, 3, d)).astype(np.int64)
            book[k // 2 :] = book[: k - k // 2]  # ties
            x = (rng.normal(size=(500, d)) * 300 * np.linspace(0.1, 3, d)).astype(np.int64)
            search = codes.Search(book.astype(dtype))
            entry, far = search.nearest(x.astype(dtype))
            full = ((x[:, None] - book[None]) ** 2).sum(2)
            assert (entry.astype(int) == full.argmin(1)).all() and (far.astype(int) == full.min(1)).all()
            if d == 16:
                assert search.share < 0.4


def test_decoded_vectors_are_entries(spark):
    rows = vectors(120, 32)
    df = spark.createDataFrame(rows, SCHEMA)
    books = codes.codebooks(df)
    out = {r["vec_id"]: r for r in codes.decode(codes.encode(df, books), books).collect()}
    for i, v, _ in random.Random(1).sample(rows, 20):
        ints = np.floor(np.array(v) * 256)
        assert int(((ints - np.array(out[i]["decoded"]) * 256) ** 2).sum()) == out[i]["error"]
