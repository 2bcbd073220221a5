"""Every registered query of the library against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from kinetable.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        path = f"{DATA}/{f}" + ("/*.parquet" if os.path.isdir(f"{DATA}/{f}") else "")
        c.execute(f"create view {f.split('.')[0]} as select * from '{path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return float(v) if hasattr(v, "as_tuple") else v


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = in_order(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got
    if name in catalog.ORACLE_SQL:
        found = duck.execute(catalog.ORACLE_SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == in_order(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_entry_works_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parent.parent
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    shutil.copytree(repo / "kinetable", tmp_path / "kinetable", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
