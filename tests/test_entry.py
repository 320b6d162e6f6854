import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from linkgrove import queries as base

ROOT = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple("NULL" if v is None else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(base.ORACLE))
def test_query_equals_sql(spark, data, duck, name):
    expect = duck.sql(base.ORACLE[name])
    got = base.QUERIES[name](spark, data)
    assert sorted(got.columns) == sorted(expect.columns)
    assert plain(map(tuple, got.select(*expect.columns).collect())) == plain(expect.fetchall())


@pytest.mark.parametrize("name", sorted(set(base.QUERIES) - set(base.ORACLE)))
def test_query_runs(spark, data, name):
    assert base.QUERIES[name](spark, data).collect() is not None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0].measure == "FM"


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(base.QUERIES) <= set(entry.queries())


def test_entry_without_the_optional_package(tmp_path):
    """The entry imports, with the other queries, where the training-data package is gone."""
    for p in ROOT.iterdir():
        if p.name in ("linkgrove", "corpus_pipeline.py", ".git"):
            continue
        (tmp_path / p.name).symlink_to(p)
    (tmp_path / "linkgrove").mkdir()
    for p in (ROOT / "linkgrove").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "linkgrove" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'cluster_matrix' in q and not any(k.startswith('op') and k[2].isdigit() for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
