"""Contiguous shards of equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.prefix import global_prefix, with_row_id
from riskloom.llm.scratch import fresh, materialise


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of a text, none for null, and one for its separator."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add shard and slot (in place of columns of these names): contiguous runs of rows in id order, near equal bytes.

    Sizes are prefix-summed over all rows in id order (null ids first, equal ids
    in any but a fixed order). A row goes where the middle of its bytes falls
    among n_shards equal targets, so a shard misses its target by at most one
    row at each end. Slots count a shard's rows from 0 without gaps. Null and
    empty texts have size 1; an empty table gives no rows. Any columns may come
    along; text goes only through the write and the final join, never through
    the sort.
    """
    uid = fresh(docs, "_uid")
    rows = with_row_id(docs, uid)
    lean = rows.select(F.col(uid).alias("_uid"), F.col(id_col).alias("_id"), byte_size(F.col(text_col)).alias("_size"), F.lit(1).cast("long").alias("_one"))
    placed = _place(lean, n_shards).select(F.col("_uid").alias(uid), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    return rows.select(uid, *(F.col(f"`{c}`") for c in kept)).join(placed, uid).drop(uid)


def _place(lean: DataFrame, n_shards: int) -> DataFrame:
    summed = global_prefix(lean, [F.col("_id"), F.col("_uid")], {"_before": "_size", "_rank": "_one"})
    total = lean.agg(F.sum("_size").alias("_total"))
    cut = F.least(F.lit(n_shards - 1).cast("long"), F.expr(f"((2 * _before + _size) * {int(n_shards)}) div (2 * _total)"))
    sharded = materialise(summed.join(F.broadcast(total)).withColumn("_shard", cut.cast("int")), "shards")  # total: one row
    first = sharded.groupBy("_shard").agg(F.min("_rank").alias("_first"))
    placed = sharded.join(F.broadcast(first), "_shard")  # one row per shard
    return placed.withColumn("_slot", F.col("_rank") - F.col("_first")).drop("_one", "_total", "_before", "_rank", "_first")


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law `bytes`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.col("text")
    lean = docs.select(
        F.col("doc_id"),
        byte_size(text).alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    rows = with_row_id(lean, "_uid")
    placed = _place(rows.select("_uid", F.col("doc_id").alias("_id"), F.col("size").alias("_size"), "doc_id", "size", "text_crc32", F.lit(1).cast("long").alias("_one")), 16)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


OP8_SQL = """
WITH RECURSIVE step(k, i, c) AS (SELECT k, 0, k FROM range(256) t(k) UNION ALL SELECT k, i + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM step WHERE i < 8),
crc AS (SELECT list(c ORDER BY k) AS t FROM step WHERE i = 8),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, size, list_reduce(list_transform(range(0, size - 1), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)), lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1]), 4294967295) AS c FROM d CROSS JOIN crc),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS before, sum(size) OVER () AS total FROM b),
s AS (SELECT *, CAST(least(15, (2 * before + size) * 16 // (2 * total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, xor(c, 4294967295) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""
