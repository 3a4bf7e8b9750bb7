"""The pipeline's stages: columns, effects, clashing names and empty input."""

import pytest

import corpus_pipeline
from riskloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert set(columns) <= set(docs.columns)
        assert name == "shard" or docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] and sizes[4] == sizes[5]


def test_awkward_rows(spark):
    rows = [(None, None, None), (None, "", "a"), (1, "x " * 50000, "a"), (1, "x " * 50000, "a"), (2, "words that stand alone here", None)]
    docs = spark.createDataFrame([(*r, 1, "s", "q", 2, True, 3) for r in rows], "doc_id long, text string, source string, _uid int, shard string, quality string, id int, kept boolean, size int")
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, some, SF)
            assert name == "shard" or out.columns == docs.columns
            assert out.count() <= 3 * some.count()


def test_ids_with_two_texts(spark):
    """Texts of one id are documents of their own: each is linked and dropped, or kept, by itself."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(0, a), (1, a + " more"), (1, b), (2, c), (2, b + " more"), (3, c + " more"), (None, a), (None, "alone"), (3, "x y"), (3, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted(map(repr, map(tuple, left))) == sorted(map(repr, [(0, a), (1, b), (2, c), (None, "alone"), (3, "x y")]))


def test_registered():
    import __spark_entry__

    assert {"pipeline", *QUERIES} <= set(__spark_entry__.queries())
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
