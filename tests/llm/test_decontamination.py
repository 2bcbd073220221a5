import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from kinetable.llm import decontaminate as d
from kinetable.llm import tokens

WORDS = [a + b + c for a in ("ka", "lo", "mi", "ne", "pu") for b in ("ba", "de", "fi", "go") for c in ("n", "s", "t", "rk")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def case():
    rng = random.Random(4)
    items = [(i, sentence(rng, rng.choice((6, 20, 50, 130)))) for i in range(40)]
    docs = []
    for i in range(60):
        t = sentence(rng, rng.choice((30, 200, 900)))
        if i % 3 == 0:
            w = items[rng.randrange(40)][1].split()
            if i % 2:
                w[len(w) // 2] = "changed"
            t += " " + " ".join(w).upper() + ", " + sentence(rng, 80)
        docs.append((i, t))
    return docs + [(100, None), (101, ""), (102, "word")], [*items, (90, None), (91, "too short")]


def brute_force(docs, items, score=d.SCORE, least=d.OVERLAP):
    """All passages of all documents against all items, in words and with plain formulas; shares no code with the operator."""

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())

    def halves(t):
        m = re.search(r"\n\s*(?:answer|a)\s*:|(?<=\?)", t or "", re.I)
        if m and t[: m.start()].strip() and t[m.end() :].strip():
            return words(t[: m.start()]), words(t[m.end() :])
        w = (t or "").split()
        at = len(w) - len(w) // 3
        return words(" ".join(w[:at])), words(" ".join(w[at:]))

    split = {i: halves(t) for i, t in items}
    split = {i: x for i, x in split.items() if x[0] + x[1]}
    mean = sum(len(q) + len(a) for q, a in split.values()) / len(split)
    df = Counter(w for q, a in split.values() for w in {*q, *a})
    weight = {}
    for i, (q, a) in split.items():
        own = {}
        for w, tf in Counter(q + a).items():
            own[w] = math.log(1 + (len(split) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(q + a) / mean))
        weight[i] = {w: x / sum(own.values()) for w, x in own.items()}

    def share(part, passage):
        n = min(5, len(part))
        if not n:
            return 1.0
        runs = {tuple(passage[k : k + n]) for k in range(len(passage) - n + 1)}
        held = {k + j for k in range(len(part) - n + 1) if tuple(part[k : k + n]) in runs for j in range(n)}
        return len(held) / len(part)

    out = {}
    for doc, text in docs:
        w = words(text)
        for i, (q, a) in split.items():
            n = len(q) + len(a)
            stride = 64
            while stride < n:
                stride *= 2
            for start in range(0, len(w), stride):
                passage = w[start : start + 2 * stride]
                s = sum(x for t, x in weight[i].items() if t in {*passage})
                if s >= score - 1e-9 and (share(q + a, passage) == 1 if n < 5 else min(share(q, passage), share(a, passage)) >= least):
                    out[doc, i] = max(out.get((doc, i), 0.0), min(1.0, s))
    return out


def test_leaks_against_brute_force(spark, documents, case):
    docs, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in d.contaminated(documents(docs), bench).collect()}
    want = brute_force(docs, items)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    assert len({k[0] for k in got}) >= 20 - 3


def built(items, most=d.INDEX_WORDS):
    rows = d.hashed([(i, *d.question_and_answer(t or "")) for i, t in items])
    return [x for p in d.indexes(rows, d.Collection.of([np.concatenate(r[1:]) for r in rows]), most) for x in p]


def full_scores(index, terms):
    out = [0.0] * len(index.ids)
    for t in terms:
        for at in range(index.first[t], index.first[t + 1]):
            out[index.items[at]] += index.weights[at]
    return out


@pytest.mark.parametrize("least", [0.05, 0.2, 0.5])
def test_the_search_finds_all_items_above_a_threshold(case, least):
    docs, items = case
    rng = random.Random(1)
    items = [*items, *((200 + i, sentence(rng, rng.choice((7, 30, 60)))) for i in range(300))]
    for index in built(items):
        assert all(abs(x - 1) < 1e-9 for x in full_scores(index, range(len(index.terms))))
        for _, text in docs[:20]:
            known = sorted({int(k) for k in index.lookup(tokens.words_of([text]).hashes[:128]) if k >= 0})
            want = {i: s for i, s in enumerate(full_scores(index, known)) if s >= least}
            owner, item, score = index.search(np.zeros(len(known), np.int64), np.array(known, np.int64), 1, least)
            got = dict(zip(item.tolist(), score.tolist()))
            assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got) and not owner.any()


def test_many_passages_and_blocks_at_once(case, monkeypatch):
    monkeypatch.setattr(d, "WIDTH", 5)
    monkeypatch.setattr(d, "PAIRS", 7)
    docs, items = case
    rng = random.Random(1)
    index = max(built([*items, *((200 + i, sentence(rng, 30)) for i in range(150))]), key=lambda x: len(x.ids))
    passages = [sorted({int(k) for k in index.lookup(tokens.words_of([t]).hashes[:128]) if k >= 0}) for _, t in docs[:40]]
    owner = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
    found = index.search(owner, np.concatenate(passages).astype(np.int64), len(passages), 0.3)
    want = {(n, i): s for n, p in enumerate(passages) for i, s in enumerate(full_scores(index, p)) if s >= 0.3}
    assert {(n, i) for n, i, _ in zip(*(x.tolist() for x in found))} == set(want) and want


def test_blocks_below_the_threshold_are_skipped(monkeypatch):
    """Of long postings that can't reach the threshold together few are met."""
    rng = random.Random(3)
    common = sentence(rng, 12)
    index = built([(i, f"{common} u{i}a u{i}b u{i}c u{i}d") for i in range(2000)])[0]
    terms = np.array(sorted(int(k) for k in set(index.lookup(tokens.words_of([f"{common} u77a u77b u77c u77d"]).hashes).tolist())), np.int64)
    passage = np.zeros(len(terms), np.int64)
    reached = sum((index.bounds(passage, terms, 1, a, 100) >= 0.9).sum() for a in range(0, index.n_blocks, 100))
    owner, item, score = index.search(passage, terms, 1, 0.9)
    assert reached == 1 and [index.ids[i] for i in item] == [77] and abs(score[0] - 1) < 1e-9
    assert not len(index.search(passage, terms, 1, 1.1)[0])


def test_scores_do_not_depend_on_passes(spark, documents, case, monkeypatch):
    docs, items = case
    half = [(i, " ".join(t.split()[: int(len(t.split()) * 0.55)])) for i, t in items[:40]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = documents([*docs, *((300 + i, t) for i, t in half)])
    run = lambda: sorted((r["doc_id"], r["item_id"], round(r["score"], 6)) for r in d.contaminated(df, bench, least=0.0).collect())
    want = run()
    monkeypatch.setattr(d, "passes", lambda b, n=3, f=d.passes: f(b, n))
    assert len(list(d.passes(bench))) > 10 and run() == want


def test_short_items_stand_word_for_word(spark, documents):
    bench = spark.createDataFrame([(1, "nine lives? cat"), (2, "blue moon"), (3, "?!")], "item_id long, text string")
    docs = documents([(1, "a nine lives cat sat"), (2, "cat of nine lives"), (3, "once in a Blue Moon, he said"), (4, "moon blue"), (None, "blue moon"), (3, "once in a Blue Moon, he said")])
    assert sorted((r["doc_id"] or -1, r["item_id"]) for r in d.contaminated(docs, bench).collect()) == [(-1, 2), (1, 1), (3, 2), (3, 2)]


def test_clean_documents_stay(spark, documents, case):
    docs, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = documents(docs)
    kept = d.decontaminate(df, bench)
    bad = {k[0] for k in brute_force(docs, items)}
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - bad


def test_question_and_answer_must_both_be_there(spark, documents):
    question, answer = "which river runs through the old town of the seven gates?", "the long green river of the northern hills and dales"
    bench = spark.createDataFrame([(1, question, answer)], "item_id long, question string, answer string")
    docs = documents([(1, f"so: {question} {answer}."), (2, f"so: {question} nobody knows, not even the mayor of the town"), (3, answer)])
    assert [r["doc_id"] for r in d.contaminated(docs, bench).collect()] == [1]


def test_passes_and_empty_tables(spark, documents, case, monkeypatch):
    docs, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(tuple(r) for r in d.contaminated(documents(docs), bench).select("doc_id", "item_id").collect())
    monkeypatch.setattr(d, "indexes", lambda rows, c, most=300, f=d.indexes: f(rows, c, most))
    assert len(list(d.passes(bench, 10))) > 3
    got = sorted(tuple(r) for r in d.contaminated(documents(docs), bench).select("doc_id", "item_id").collect())
    assert got == want
    assert d.contaminated(documents(docs), bench.limit(0)).count() == 0
    assert d.decontaminate(documents(docs), bench.limit(0)).count() == len(docs)
    assert d.contaminated(documents(docs).limit(0), bench).count() == 0


def test_splitting_of_items():
    assert d.question_and_answer("What is it? A tree.") == ("What is it?", " A tree.")
    assert d.question_and_answer("a b c d e f") == ("a b c d", "e f")
    assert d.question_and_answer("Q here\nAnswer: yes") == ("Q here", " yes")
