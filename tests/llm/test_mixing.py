import random
from collections import defaultdict

import duckdb
import pytest

from kinetable.llm import mixing


def by_sql(rows):
    c = duckdb.connect()
    c.execute("create table documents(doc_id bigint, text varchar, source varchar)")
    if rows:
        c.executemany("insert into documents values (?, ?, ?)", rows)
    found = c.execute(mixing.SQL)
    names = [d[0] for d in found.description]
    return [dict(zip(names, r)) for r in found.fetchall()]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = [(i, " ".join("w" * 3 for _ in range(rng.choice((0, 1, 5, 40, 300)))), rng.choice(("a", "a", "a", "b", "c", "d", "é", None))) for i in range(700)]
    return out + [(900, None, "a"), (901, "", "z"), (902, "one two", None), (None, "x y z", "b")]


def test_mix_equals_its_sql(spark, rows):
    df = spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as key", "3 as rank", "4 as target")
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"])
    got, want = (sorted((r if isinstance(r, dict) else r.asDict() for r in x), key=key) for x in (mixing.mix(df).collect(), by_sql(rows)))
    assert [(r["doc_id"], r["size"], r["copies"], r["taken"], round(r["target"], 6)) for r in got] == [(r["doc_id"], r["size"], r["copies"], r["taken"], round(r["target"], 6)) for r in want]


def test_targets_are_met_and_no_document_is_taken_too_often(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df).collect()
    assert len(out) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in out)
    taken, target, largest, own = defaultdict(int), {}, defaultdict(int), {}
    for r in out:
        s = r["source"]
        taken[s] += r["taken"]
        target[s], own[s] = r["target"], r["source_size"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in taken)
    total = sum(own.values())
    assert abs(sum(target.values()) - min(1.5 * total, 2 * total)) < 1e-6 * total
    assert all(target[s] <= 2 * own[s] + 1e-9 for s in target)


def test_reruns_agree_and_edges(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a = sorted(map(str, mixing.mix(df).collect()))
    assert a == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    assert mixing.mix(df.limit(0)).count() == 0
    assert [r["taken"] for r in mixing.mix(df.filter("doc_id in (900, 901)")).collect()] == [0, 0]


def test_repeated_rows_are_drawn_apart(spark):
    rows = [(1, "a b c", "s")] * 6 + [(2, "d e", "t")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df).collect()
    assert len(out) == 9 and sorted((r["doc_id"], r["copies"]) for r in out) == sorted((r["doc_id"], r["copies"]) for r in by_sql(rows))


def test_a_cut_among_repeated_rows_comes_near(spark, monkeypatch):
    """A third of all rows are repeats of one; the cut falls among them and is found without putting them in order."""
    rng = random.Random(1)
    rows = [(7, "a b c", "s")] * 400 + [(100 + i, "w " * rng.choice((2, 9)), rng.choice("st")) for i in range(60)]
    for seed in range(3):
        own = [(i, t + f" x{seed}", s) for i, t, s in rows]
        df = spark.createDataFrame(own, "doc_id long, text string, source string").repartition(3)
        got = sorted((r["doc_id"], r["copies"], r["taken"]) for r in mixing.mix(df).collect())
        assert got == sorted((r["doc_id"], r["copies"], r["taken"]) for r in by_sql(own))


def test_rows_are_taken_with_all_their_columns(spark, rows):
    own = [(i, t, s) for i, t, s in rows] + [(5, "same words", "a")] * 9 + [(None, "null id one", "b"), (None, "null id two", "b")]
    df = spark.createDataFrame(own, "doc_id long, text string, source string").selectExpr("*", "1 as copies", "2 as size", "'x' as row", "3 as `a.b`")
    out = mixing.mixed(df)
    assert out.columns == [*df.columns, "_copies"]
    by_row = lambda x: sorted((str(r["doc_id"]), r["source"] or "", r["n"]) for r in x)
    got = by_row({"doc_id": r["doc_id"], "source": r["source"], "n": r["_copies"]} for r in out.collect())
    assert got == by_row({"doc_id": r["doc_id"], "source": r["source"], "n": r["copies"]} for r in by_sql(own) if r["copies"])


def test_documents_are_included_as_often_as_their_odds_say(spark):
    """Over many draws: equal sizes equally often; longer documents more often, in proportion to their bit length."""
    rng = random.Random(3)
    texts = ["w " * rng.choice((3, 3, 12, 60)) for _ in range(80)]
    rows, draws = [], 150
    for k in range(draws):
        rows += [(1000 * k + i, t, f"s{k:03d}") for i, t in enumerate(texts)]
    extra = defaultdict(int)
    # Sources of equal sizes have the same target but for their weights, so those of one weight are alike.
    for r in by_sql(rows):
        if int(r["source"][1:]) % 3 == 1:
            extra[r["doc_id"] % 1000] += r["copies"] - r["target"] // r["source_size"]
    n, by = draws / 3, defaultdict(list)
    for i, t in enumerate(texts):
        by[len(t.split())].append(extra[i] / n)
    mean = {k: sum(v) / len(v) for k, v in by.items()}
    bits = {k: k.bit_length() for k in by}
    ratio = {k: mean[k] / bits[k] for k in by}
    assert max(ratio.values()) < 1.15 * min(ratio.values())
    for k, v in by.items():
        spread = (mean[k] * (1 - min(1, mean[k])) / n) ** 0.5
        assert all(abs(x - mean[k]) < 4.5 * max(spread, 0.02) for x in v)
