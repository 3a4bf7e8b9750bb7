"""Shards and mixes against plain computations, with ties, nulls and clashing names."""

import zlib

import pytest
from pyspark.sql import functions as F

from riskloom.llm.mixing import mix_sources, op4_mixing, sample_copies, source_targets
from riskloom.llm.prefix import global_prefix, with_row_id
from riskloom.llm.sharding import op8_sharding, shard_by_bytes

SCHEMA = "doc_id long, text string, source string, _uid int, slot string"


def corpus(spark):
    rows = [(i, "w " * (i % 17), f"s{i % 5}", 0, "q") for i in range(300)]
    rows += [(7, "w w", None, 0, None)] * 20 + [(None, None, "s1", 0, None), (400, "long " * 9000, "s2", None, ""), (401, "", "", 1, "")]
    return spark.createDataFrame(rows, SCHEMA)


def test_global_prefix(spark):
    df = with_row_id(spark.range(0, 1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v")), "u")
    rows = sorted(map(tuple, global_prefix(df, [F.col("k"), F.col("u")], {"before": "v"}).select("k", "u", "v", "before").collect()))
    total = 0
    for _, _, v, before in rows:
        assert before == total
        total += v


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_shards(spark, shards):
    docs = corpus(spark)
    out = shard_by_bytes(docs, shards)
    assert sorted(out.columns) == sorted(["doc_id", "text", "source", "_uid", "slot", "shard"])
    rows = out.collect()
    size = lambda r: len((r.text or "").encode()) + 1
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.collect())
    total, longest = sum(map(size, rows)), max(map(size, rows))
    last = None
    for s in range(shards):
        own = sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        assert abs(sum(map(size, own)) - total / shards) <= longest
        for r in own:
            key = (r.doc_id is not None, r.doc_id or 0)
            assert last is None or last <= key
            last = key
    assert shard_by_bytes(docs.limit(0), shards).count() == 0


def water_fill(sizes, weights, most):
    """Targets by repeated resharing."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            target |= {s: level * w[s] for s in free}
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= over
    return target


def test_targets_and_copies(spark):
    docs = corpus(spark).select("doc_id", "text", "source")
    sized = with_row_id(docs.select("doc_id", "source", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != "")).cast("long").alias("size")), "_uid")
    sizes = {r.source: r.s for r in sized.groupBy("source").agg(F.sum("size").alias("s")).collect()}
    want = water_fill(sizes, (5, 2, 1), 3)
    got = {r.source: r.target for r in source_targets(sized, (5, 2, 1), 3).collect()}
    assert got.keys() == want.keys()
    for s in want:
        assert abs(got[s] - want[s]) < 1e-6 * max(1, want[s])
    rows = sample_copies(sized).collect()
    assert len(rows) == docs.count()
    for s, target in want.items():
        own = [r for r in rows if r.source == s]
        rate = target / sizes[s] if sizes[s] else 0
        assert all(int(rate) <= r.copies <= min(3, int(rate) + 1) for r in own)
        assert abs(sum(r.copies for r in own) - rate * len(own)) <= 1
    again = sample_copies(sized).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_mix_keeps_columns(spark):
    docs = corpus(spark)
    out = mix_sources(docs)
    assert out.columns == docs.columns
    assert max(r["count"] for r in out.filter("doc_id <> 7").groupBy("doc_id").count().collect()) <= 3
    assert mix_sources(docs.limit(0)).count() == 0


def test_queries(spark, tmp_path):
    corpus(spark).drop("_uid", "slot").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op8_sharding(spark, str(tmp_path)).collect():
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
    texts = {r.doc_id: r.text for r in corpus(spark).collect()}
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in op8_sharding(spark, str(tmp_path)).collect() if r.doc_id != 7)
    rows = op4_mixing(spark, str(tmp_path)).collect()
    assert all(0 <= r.taken <= 3 * r.size for r in rows)


def test_plans_are_native(spark, tmp_path):
    corpus(spark).drop("_uid", "slot").write.parquet(f"{tmp_path}/documents.parquet")
    for query in (op4_mixing, op8_sharding):
        plan = query(spark, str(tmp_path))._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))
