import hashlib
import random

import numpy as np
import pyarrow as pa

from kinetable.llm import fim


def by_hand(i, t):
    t = t or ""
    n = len(t)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = t[:low], t[low:high], t[high:]
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (i, n, "plain", None, None, t)
    if h4 % 100 < 20:
        return (i, n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m)
    return (i, n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m)


def cases():
    rng = random.Random(4)
    letters = "ab \né𝄞漢<PSM>́\x00"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 60)))) for i in range(600)]
    rows += [(i, "x" * rng.randrange(0, 9)) for i in range(600, 700)]
    return [*rows, (1000, None), (1001, ""), (None, "no id at all"), (1002, "a<P>b"), (1003, "é𝄞x" * 700_000), (1004, "word " * 300_000), (1005, "<"), (5, "twice"), (5, "twice")]


def test_equals_plain_slices(spark, documents):
    rows = cases()
    df = fim.transform(documents(rows).selectExpr("*", "1 as n", "2 as form", "3 as output").repartition(3))
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in df.collect()), key=str)
    want = sorted((by_hand(i, t) for i, t in rows), key=str)
    assert got == want and {r[2] for r in got} == {"plain", "spm", "psm"}


def test_texts_come_back(spark, documents):
    rows = cases()
    out = fim.summary(fim.transform(documents(rows))).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((str(r["doc_id"]), r["restored_sha256"]) for r in out) == sorted((str(i), sha(t)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["output_sha256"]) for r in out) == sorted((str(i), sha(by_hand(i, t)[5])) for i, t in rows)


def test_other_columns_are_kept(spark, documents):
    df = documents(cases())
    out = fim.transform(df, ["source", "doc_id", "text", "label"])
    assert out.columns == ["source", "doc_id", "text", "label", "n", "form", "prefix_chars", "middle_chars", "output"] and out.count() == df.count()
    assert all(r["text"] == r["output"] for r in out.filter("form = 'plain' and text is not null").collect())


def test_empty_table(spark, documents):
    assert fim.summary(fim.transform(documents([]))).collect() == []


def test_runs_are_maximal_and_find_each_byte(monkeypatch):
    rng = random.Random(8)
    for piece in (1, 2, 3, 7, 1 << 20):
        monkeypatch.setattr(fim, "PIECE", piece)
        for _ in range(60):
            texts = ["".join(rng.choice("aé漢𝄞") * rng.randrange(1, 5) for _ in range(rng.randrange(0, 6))) for _ in range(rng.randrange(1, 5))]
            data, at = fim.text_bytes(pa.array(["skipped", *texts])[1:])
            runs = fim.Runs(data, at)
            want = []  # first byte, units before, width
            b = u = 0
            for t in texts:
                last = None
                for c in t:
                    w = len(c.encode())
                    if w != last:
                        want.append((b, u, w))
                    b, u, last = b + w, u + 1, w
            assert list(zip(runs.first.tolist(), runs.before.tolist(), runs.width.tolist())) == want
            whole = "".join(texts)
            units = np.arange(len(whole) + 1)
            byte = np.array([len(whole[:k].encode()) for k in units])
            assert (runs.byte_of(units) == byte).all() and (runs.unit_of(byte) == units).all()
