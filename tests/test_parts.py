import random
import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kinetable.operators import align
from kinetable.sources import logs, parts


def packed(rng, n, largest):
    body, want = b"", []
    for i in range(n):
        payload = bytes(rng.randrange(256) for _ in range(rng.randrange(0, largest)))
        want.append((i, rng.randrange(1000), payload))
        body += struct.pack("<qI", want[-1][1], len(payload)) + payload
    return body, want


@pytest.mark.parametrize("size", [200, 1 << 20])
def test_packets_of_cut_files(spark, tmp_path, size):
    rng = random.Random(size)
    want = {}
    for name, n, largest, tail in (("a", 300, 40, b""), ("b", 40, 500, struct.pack("<qI", 1, 99) + b"torn"), ("c", 1, 5, b"x"), ("d", 0, 1, b"only torn")):
        body, rows = packed(rng, n, largest)
        (tmp_path / f"{name}.bin").write_bytes(body + tail)
        want |= {(name, i): (x, p) for i, x, p in rows}
    (tmp_path / "empty.bin").write_bytes(b"")
    # Payloads that look like packets themselves.
    nested = [(i, i, b"".join(struct.pack("<qI", 7, 0) for _ in range(30))) for i in range(20)]
    (tmp_path / "n.bin").write_bytes(b"".join(struct.pack("<qI", x, len(p)) + p for _, x, p in nested))
    want |= {("n", i): (x, p) for i, x, p in nested}
    got = parts.packets(spark, str(tmp_path), "<qI", ["id", "size"], "size", size).collect()
    assert {(r["path"].rsplit("/", 1)[1][:-4], r["seq"]): (r["id"], bytes(r["payload"])) for r in got} == want and len(got) == len(want)
    plain = logs.read_packets(spark, str(tmp_path), "<qI", ["id", "size"], "size")
    assert plain.count() == len(want)


def test_one_packet_file_is_many_ranges(spark, tmp_path):
    body, rows = packed(random.Random(1), 2000, 60)
    (tmp_path / "a.bin").write_bytes(body)
    known = lambda h: 0 <= h["id"] < 1000 and h["size"] < 60
    got = parts.packets(spark, str(tmp_path), "<qI", ["id", "size"], "size", 4096, known)
    assert got.count() == 2000 and got.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 3


def test_sampled_row_groups(spark, tmp_path):
    for name, rows, group in (("a", 1000, 100), ("b", 250, 100), ("c", 5, 100)):
        pq.write_table(pa.table({"i": range(rows), "s": [name] * rows, "v": [float(i) for i in range(rows)]}), tmp_path / f"{name}.parquet", row_group_size=group)
    groups = parts.row_groups(spark, str(tmp_path)).collect()
    assert sorted(r["rows"] for r in groups if r["path"].endswith("b.parquet")) == [50, 100, 100]
    got = parts.sampled_groups(spark, str(tmp_path), 3, ["i", "s"])
    assert got.columns == ["i", "s", "weight"]
    by = {r["s"]: r for r in got.groupBy("s").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.max("i").alias("top")).collect()}
    assert {s: r["n"] for s, r in by.items()} == {"a": 400, "b": 100, "c": 5}
    assert all(abs(by[s]["w"] - n) < 1e-6 for s, n in (("a", 1000), ("b", 250), ("c", 5))) and by["a"]["top"] == 999


def test_token_overlap_equals_all_pairs(spark):
    rng = random.Random(5)
    words = ["left", "right", "hand", "imu", "rgb", "depth", "cam", "glove", "common", "ts"]
    weights = [1, 1, 2, 1, 1, 1, 3, 1, 20, 8]
    names = lambda n: list({"_".join(dict.fromkeys(rng.choices(words, weights, k=rng.randrange(1, 6)))) for _ in range(n)}) + ["", "--"]
    a, b = names(150), [*names(120), "Common TS", "none of these zzz"]
    got = align.token_overlap(spark.createDataFrame([(x,) for x in a], "x string"), spark.createDataFrame([(x,) for x in b], "y string"), "x", "y").collect()
    import re

    toks = lambda s: {t for t in re.split(r"[^a-z0-9]+", s.lower()) if t}
    want = set()
    for x in a:
        best = max((len(toks(x) & toks(y)) for y in b), default=0)
        want |= {(x, y, best) for y in b if best and len(toks(x) & toks(y)) == best}
    assert {(r["name"], r["match"], r["shared"]) for r in got} == want and len(got) == len(want)


def test_token_in_all_names_meets_only_what_shares_no_better(spark):
    n = 4000
    a = spark.range(n).select(F.concat(F.lit("device common "), F.col("id")).alias("x"))
    b = spark.range(n).select(F.concat(F.lit("common sensor "), F.col("id")).alias("y"))
    got = align.token_overlap(a, b, "x", "y")
    assert got.count() == n and got.filter("shared <> 2 or substring_index(name, ' ', -1) <> substring_index(match, ' ', -1)").isEmpty()
    assert align.token_overlap(a.limit(0), b, "x", "y").count() == 0 and align.token_overlap(a, b.limit(0), "x", "y").count() == 0
