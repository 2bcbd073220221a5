import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kinetable.llm import exactdup


def by_hand(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t))
    out = []
    for own, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1] or ""), m[0] is None, m[0] or 0))
        for i, t in members:
            out.append((i, best[0], len(members), hashlib.sha256(own.encode()).hexdigest(), (len(t or ""), i) == (len(best[1] or ""), best[0])))
    return out


def cases():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(("a", "b", "é", "𝄞", " ")) for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    rows = [(i, rng.choice((t, t.replace(" ", "\n"), " " + t, t.upper()))) for i, t in enumerate(texts + texts[:100])]
    rows += [(900 + i, "the hot one" + " " * (i % 3)) for i in range(300)]
    return [*rows, (2000, None), (2001, ""), (2002, " \t\n\x0b\f\r "), (2003, "long " * 50_000), (2004, "long" * 50_000), (None, "no id"), (None, "noid"), (7, "no id")]


def test_equals_brute_force(spark, documents):
    rows = cases()
    got = exactdup.duplicates(documents(rows)).collect()
    assert sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["text_sha256"], r["kept"]) for r in got) == sorted((a or -1, b or -1, n, h, k) for a, b, n, h, k in by_hand(rows))


def test_repeated_rows_keep_one(spark, documents):
    rows = [(1, "same")] * 5 + [(2, "sa me")] * 3 + [(None, "x")] * 2
    got = exactdup.duplicates(documents(rows)).collect()
    assert [r["doc_id"] for r in got if r["kept"]].count(2) == 1 and sum(r["kept"] for r in got) == 2 and {r["group_size"] for r in got} == {8, 2}
    assert {r["keep_id"] for r in got} == {2, None}
    stays = exactdup.deduplicate(documents(rows))
    assert sorted(r["doc_id"] or 0 for r in stays.collect()) == [0, 2] and stays.columns == documents(rows).columns


def test_deduplicate_keeps_columns_and_the_rows_that_stay(spark, documents):
    rows = cases()
    got = exactdup.deduplicate(documents(rows).withColumn("row", F.lit(1)).withColumnRenamed("score", "a.b"))
    assert "a.b" in got.columns and "row" in got.columns
    want = {(b, h) for _, b, _, h, _ in by_hand(rows)}
    assert sorted((r["doc_id"] or -1, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "").encode()).hexdigest()) for r in got.collect()) == sorted((b or -1, h) for b, h in want)


def test_empty_table(spark, documents):
    assert exactdup.duplicates(documents([])).collect() == [] and exactdup.deduplicate(documents([])).collect() == []


@pytest.mark.parametrize("most", [1 << 15, 1 << 30])
def test_any_size_of_the_filter_gives_the_same(spark, documents, most):
    rows = cases() + [(10_000 + i, f"only {i}") for i in range(20_000)]
    got = exactdup.duplicates(documents(rows), most)
    want = by_hand(rows)
    assert sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"]) for r in got.collect()) == sorted((a or -1, b or -1, n) for a, b, n, _, _ in want)


def test_few_rows_without_a_repeat_are_shuffled(spark, documents):
    rows = [(i, f"text {i}") for i in range(20_000)] + [(50_000 + i, f"text {i}") for i in range(200)]
    alone, maybe, groups = exactdup.passes(documents(rows))
    assert 400 <= maybe.count() < 1200 and alone.count() + maybe.count() == len(rows) and groups.count() == 200


def test_bits(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 7, 8, 255, 32767)], "pos long")
    bitmap = rows.selectExpr("bitmap_construct_agg(pos) as b")
    every = spark.range(1 << 15).join(bitmap)
    assert [r["id"] for r in every.filter(exactdup.is_set(F.col("b"), F.col("id"))).select("id").orderBy("id").collect()] == [0, 7, 8, 255, 32767]


def test_native_plan_has_no_python(spark, documents):
    for df in (*exactdup.passes(documents(cases())), exactdup.duplicates(documents(cases()))):
        assert "Arrow" not in df._jdf.queryExecution().toString() and "Python" not in df._jdf.queryExecution().toString()
