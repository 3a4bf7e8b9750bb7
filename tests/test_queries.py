"""Every query against its SQL, and the contract of the entry module."""

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(entry.OWN))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    query, sql = entry.OWN[name]
    df = query(spark, SF)
    told = con.sql(sql)
    assert sorted(df.columns) == sorted(told.columns)
    kinds = dict(zip(told.columns, map(str, told.types), strict=True))
    assert all(KINDS.get(k, kinds[c]) == kinds[c] for c, k in df.dtypes)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_end_of_a_long_day(spark, tmp_path):
    """The endpoint is a day's last event, however many there are."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i::BIGINT AS event_id, TIMESTAMP '2024-01-02' + to_hours(i::INT) AS ts, 7::BIGINT AS user_id, ['view', 'view', 'view', 'click', 'view', 'error'][i] AS event_type FROM range(1, 7) t(i)) TO '{tmp_path}/events.parquet'")
    con.execute(f"COPY (SELECT * FROM '{SF}/documents.parquet') TO '{tmp_path}/documents.parquet'")
    assert entry.queries()["minimal_context"](spark, str(tmp_path)).first().endpoints == "error"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_llm(tmp_path):
    """Without the llm folders and the pipeline the rest imports and knows its queries."""
    import os
    import shutil

    root = os.path.dirname(os.path.abspath(entry.__file__))
    for part in ("riskloom", "__spark_entry__.py"):
        source = os.path.join(root, part)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / part)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hotspots' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_no_code_outside_llm_imports_it():
    import os

    root = os.path.join(os.path.dirname(os.path.abspath(entry.__file__)), "riskloom")
    for folder, _, names in os.walk(root):
        if os.sep + "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n)) as f:
                        assert "riskloom.llm" not in f.read(), n
