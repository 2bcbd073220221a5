import itertools

from pyspark.sql import functions as F

from kinetable.functions import values as V
from kinetable.operators import rollups


def test_variants_of_a_column_are_those_of_its_names(spark):
    names = ["observation.images.head_left_rgb", "Head-Left.mp4", "images.observation.x", "a.b.c.d", "observation.images.a-b_rgb.bin", ".hidden", "plain", "_rgb", "images."]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r["n"]: set(r["v"]) for r in df.select("n", rollups.source_variants("n").alias("v")).collect()}
    assert got == {n: rollups.name_variants(n) for n in names}
    pairs = {(r["name"], r["match"]) for r in rollups.matched_sources(df, df, "n", "n").collect()}
    assert pairs == {(a, b) for a, b in itertools.product(names, names) if rollups.same_source(a, b)}


def test_lists_of_offsets(spark):
    df = spark.createDataFrame([([1, 2, 3], [0, 0, 2, 3]), ([], [0, 0])], "a array<int>, o array<int>")
    assert [r["x"] for r in df.select(V.lists_of("a", "o").alias("x")).collect()] == [[[], [1, 2], [3]], [[]]]
    assert df.select(V.lists_of("a", F.array(F.lit(0), F.lit(1))).alias("x")).first()["x"] == [[1]]
