"""Each stage of the pipeline against a plain form of it, on what the stage before has kept."""

import duckdb
import pytest

import corpus_pipeline as p
from kinetable.llm import decontaminate, language, mixing, secrets
from tests.llm.test_decontamination import brute_force as leaks
from tests.llm.test_near_duplicates import brute_force as classes

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """The rows before the first stage and after each."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = [(9001, None, "en", "src0", 0), (9002, "", None, None, None), (9003, "12 34 56", "en", "src1", 8), (9004, "The words of this text give away that password = hunter22x and that token: abcdef0123 in the end.", "en", "src1", 95)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    out = [docs.cache()]
    for name, stage in p.STAGES:
        out.append(stage(spark, out[-1], DATA).cache())
        assert out[-1].columns == (docs.columns if name != "source_mixing" else [*docs.columns, "copies"])
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_language_stage(kept):
    langs, net = language.train(kept[0])
    rows = kept[0].collect()
    pred, score = language.classify([r["text"] for r in rows], langs, net)
    assert ids(kept[1]) == sorted(r["doc_id"] for r, x, s in zip(rows, pred, score) if x != "und" and s >= language.least_score(langs))
    assert not {9001, 9002, 9003} & {*ids(kept[1])}
    assert len(ids(kept[1])) >= 0.97 * len(rows)


def test_near_duplicate_stage(kept):
    own = classes([(r["doc_id"], r["text"]) for r in kept[1].collect()])
    assert ids(kept[2]) == sorted(set(own.values()))


def test_decontamination_stage(spark, kept):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in kept[2].collect()]
    bad = {d for d, _ in leaks(rows, bench)}
    assert bad and ids(kept[3]) == sorted(d for d, _ in rows if d not in bad)
    assert decontaminate.SCORE < 1


def test_secret_stage(kept):
    before = {r["doc_id"]: r for r in kept[3].collect()}
    changed = 0
    for r in kept[4].collect():
        old = before.pop(r["doc_id"])
        spans = secrets.spans_of([old["text"]])[0]
        assert r["text"] == secrets.masked(old["text"], spans) and r["n_chars"] == len(r["text"]) and r["source"] == old["source"]
        assert not secrets.spans_of([r["text"]])[0]
        changed += bool(spans)
    assert not before and changed


def test_mixing_stage(kept):
    c = duckdb.connect()
    c.execute("create table documents(doc_id bigint, text varchar, source varchar)")
    c.executemany("insert into documents values (?, ?, ?)", [(r["doc_id"], r["text"], r["source"]) for r in kept[4].collect()])
    want = {r[0]: r[1] for r in c.execute(f"select doc_id, copies from ({mixing.SQL}) where copies > 0").fetchall()}
    assert {r["doc_id"]: r["copies"] for r in kept[5].collect()} == want


def test_run_applies_the_stages_to_the_documents(spark):
    out = p.run(spark, DATA)
    assert out.columns[-1] == "copies" and out.count() > 100 and [n for n, _ in p.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "source_mixing"]


def test_rows_without_an_id_pass_through(spark):
    docs = spark.createDataFrame([(None, "the words of one text", "en", "a", 21), (None, "the words of one text", "en", "a", 21), (5, "other words of a text", "en", "a", 21)], "doc_id long, text string, lang string, source string, n_chars long")
    assert p.near_dedup(spark, docs, DATA).count() == 3
    assert {r["doc_id"] for r in p.source_mixing(spark, docs, DATA).collect()} == {None, 5}
    assert p.source_mixing(spark, docs.limit(0), DATA).count() == 0
