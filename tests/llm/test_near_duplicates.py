import math
import random
from collections import defaultdict

import numpy as np
import pytest

from kinetable.llm import neardup, tokens

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "si", "to") for b in ("bar", "den", "fil", "gor", "hut", "jam")]


def brute_force(rows, least=0.8):
    """Class of each doc_id by all pairs of shingle sets."""
    import re

    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if (not x and not y) or (both and both >= least * (len(x) + len(y) - both)):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def corpus(seed=1, groups=12):
    rng = random.Random(seed)
    rows, n = [], 0
    for g in range(groups):
        base = [rng.choice(WORDS) for _ in range(rng.choice((3, 6, 40, 150)))]
        for _ in range(rng.choice((1, 2, 5, 25))):
            own = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 6))):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            rows.append((n, " ".join(own).capitalize() + rng.choice((".", "!", ""))))
            n += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_against_brute_force(documents, seed):
    rows = corpus(seed) + [(900, None), (901, ""), (902, "?!"), (903, "one"), (904, "One."), (905, "x " * 30_000)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(documents(rows)).collect()}
    assert got == brute_force(rows)


def test_driver_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()} == brute_force(rows)


def test_a_bucket_of_unlike_texts_is_compared_whole(documents, monkeypatch):
    """With one register for a band all pairs of a large group meet, in blocks smaller than the group."""
    monkeypatch.setattr(neardup, "ROWS", 1)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(120)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.randrange(14)):
            own[rng.randrange(len(own))] = rng.choice(WORDS)
        rows.append((i, " ".join(own)))
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(documents(rows)).collect()}
    assert got == brute_force(rows) and 1 < len(set(got.values())) < 60


def test_null_ids_repeated_rows_and_empty_tables(documents):
    docs = documents([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (5, "A, b; c d e f!")])
    got = sorted((r["doc_id"] or -1, r["class_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect())
    assert got == [(-1, None, True), (3, 3, True), (3, 3, True), (5, 3, False)]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 3]


def test_sketch_estimates_the_probability_jaccard_similarity():
    rng = np.random.default_rng(3)
    items = rng.integers(0, 1 << 48, 300, dtype=np.uint64)
    x, y = np.sort(items[:220]), np.sort(items[60:])
    wx, wy = {v: 1 + (v % np.uint64(3)) for v in x}, {v: 1 + (v % np.uint64(2)) for v in y}
    m = 4096
    owner = np.repeat([0, 1], [len(x), len(y)])
    sketch = neardup.probminhash(np.concatenate([x, y]), owner, np.array([*map(float, wx.values()), *map(float, wy.values())]), 2, m)
    exact = 0.0
    for i in set(wx) & set(wy):
        exact += 1 / sum(max(float(wx.get(j, 0)) / float(wx[i]), float(wy.get(j, 0)) / float(wy[i])) for j in set(wx) | set(wy))
    assert abs((sketch[0] == sketch[1]).mean() - exact) < 4 * math.sqrt(exact * (1 - exact) / m)


def test_word_hashes_are_those_of_equal_words():
    texts = ["Ab, cd-EF 12é", None, "", "ef ab", "  ", "é é"]
    w = tokens.words_of(texts)
    assert w.counts.tolist() == [4, 0, 0, 2, 0, 2]
    h = w.hashes
    assert h[2] == h[4] and h[0] == h[5] and h[6] == h[7] and len(set(h.tolist())) == 5


def test_shingles_of_short_texts():
    s, owner = tokens.shingles(tokens.words_of(["a b", "a b c d e f", "", "a b"]))
    by = defaultdict(list)
    for x, o in zip(s.tolist(), owner.tolist()):
        by[o].append(x)
    assert [len(by[i]) for i in range(4)] == [1, 2, 0, 1] and by[0] == by[3]


def test_pairs_with_other_repeat_counts_share_a_band():
    rng = random.Random(7)
    texts = []
    for _ in range(60):
        base = [rng.choice(WORDS) for _ in range(104)]
        texts += [" ".join(base), " ".join(base + base[:24] * 50)]
    classes = brute_force(list(enumerate(texts)))
    assert all(classes[i] == i - i % 2 for i in range(120))  # sets alike at 0.8 or more
    _, bands, _ = neardup.band_hashes(texts)
    assert all(set(bands[i].tolist()) & set(bands[i + 1].tolist()) for i in range(0, 120, 2))


def test_texts_that_repeat_other_lines_are_linked(documents):
    """Set similarities of about 0.88, far lower ones of weighted sets: as many links as by brute force."""
    rng = random.Random(11)
    rows = []
    for g in range(20):
        lines = [" ".join(rng.choice(WORDS) for _ in range(12)) for _ in range(10)]
        rows += [(2 * g, " ".join(lines + lines[:5] * 60)), (2 * g + 1, " ".join(lines + lines[5:] * 60))]
    want = brute_force(rows)
    assert sum(want[i] != i for i in want) >= 15
    df = documents(rows)
    found = neardup.near_duplicates(df)
    assert {r["doc_id"]: r["class_id"] for r in found.collect()} == want
    assert neardup.recall(df, found) == 1.0


def test_recall_tells_lost_links(documents):
    rows = corpus(4)
    df = documents(rows)
    lost = df.selectExpr("doc_id", "doc_id as class_id", "true as kept")
    assert neardup.recall(df, neardup.near_duplicates(df)) == 1.0 and neardup.recall(df, lost) == 0.0


def test_different_texts_of_one_id_are_not_lost(documents):
    a, b, c = "one two three four five six seven", "red green blue black white grey pink", "up down left right north south east"
    docs = documents([(1, a), (5, a), (5, b), (5, b), (7, c), (1, c), (None, a)])
    got = sorted((r["doc_id"] or -1, r["text"]) for r in neardup.deduplicate(docs).collect())
    assert got == sorted([(1, a), (5, b), (1, c), (-1, a)])


def test_one_id_of_many_texts_costs_each_row_once(documents, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(4000)]
    texts = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(150)]
    rows = [(7, t) for t in texts] + [(7, t + " more") for t in texts]
    seen = []
    plain = neardup.map_texts
    monkeypatch.setattr(neardup, "map_texts", lambda df, keep, fields, *a: seen.append((fields, df)) or plain(df, keep, fields, *a))
    found = neardup.classes(documents(rows))
    assert found.filter("keeper").select("key").distinct().count() == 150 and found.select("class_id").distinct().count() == 1
    assert [df.count() for fields, df in seen if "shingles" in fields] == [300]


def test_a_hub_with_many_rays_is_compared_in_parts(documents, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "RAYS", 3)
    import kinetable.llm.common as common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "EDGES", 10)
    rng = random.Random(3)
    base = [rng.choice(WORDS) for _ in range(200)]
    rows = [(i, " ".join(base[:100] + [rng.choice(WORDS)] + base[101:])) for i in range(60)] + [(100 + i, " ".join(rng.choice(WORDS) for _ in range(30))) for i in range(20)]
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(documents(rows)).collect()} == brute_force(rows)
