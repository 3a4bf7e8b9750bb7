"""Exact top-k inner products with a vector-approximation file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.scratch import drop, materialise

#: Vectors of a step of the scan, and candidates that a task holds before it compacts or sends them.
_STEP, _HELD = 2048, 1 << 18
#: Components count as this at most, so that differences of two fit 64 bits.
_LIMIT = 1 << 61


def _dense(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A list or binary column as a matrix of 64-bit integers; shorter vectors end in zeros."""
    rows = [np.frombuffer(v.as_py(), np.int64) if isinstance(v, pa.BinaryScalar) else np.array(v.as_py(), np.int64) for v in column]
    wide = max(map(len, rows), default=0) if width is None else width
    out = np.zeros((len(rows), wide), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """id and vector = floor(scale * x) for vectors that are whole: no null, no null or non-finite component.

    One row an id: of rows that repeat it the one of the least vector.
    """
    whole = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    limit = F.lit(_LIMIT)
    numbers = F.transform(vector_col, lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale).cast("long"), -limit), limit))
    rows = df.filter(F.col(vector_col).isNotNull() & whole & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), numbers.alias("vector"))
    return rows.groupBy("id").agg(F.min("vector").alias("vector"))


def _extremes(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest component in each dimension; one row per dimension reaches the driver."""
    at = vectors.select(F.posexplode("vector").alias("d", "x"))
    rows = sorted(tuple(r) for r in at.groupBy("d").agg(F.min("x"), F.max("x")).collect())
    return np.array([min(0, r[1]) for r in rows], np.int64), np.array([max(0, r[2]) for r in rows], np.int64)


def build_file(vectors: DataFrame, k: int, bits: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(file, lows, widths): rows id, cells, vector, with 2**bits cells a dimension.

    Of equal vectors the k + 1 of smallest id stay: no other one can be among a
    query's k best, itself left out, as ties go to the smaller id.
    """
    same = Window.partitionBy("vector").orderBy("id")
    kept = materialise(vectors.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= k + 1).drop("_n"), "vectors")
    lows, highs = _extremes(kept)
    widths = np.maximum(1, -(-(highs - lows + 1) // (1 << bits)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            exact = _dense(batch["vector"], len(lows))
            cells = ((exact - lows) // widths).astype(np.uint8 if bits <= 8 else np.uint16)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([c.tobytes() for c in cells], pa.binary()), pa.array([v.tobytes() for v in exact], pa.binary())], ["id", "cells", "vector"])

    file = materialise(kept.mapInArrow(run, "id long, cells binary, vector binary"), "va-file")
    drop(kept)
    return file, lows, widths


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, bits: int = 6, block: int = 4096, chunk: int = 1 << 16) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best other rows.

    The score is the inner product of floor(scale * x). Blocks of about `block`
    queries meet chunks of about `chunk` rows of the file: cells give bounds of
    the score, and a row stays if its upper bound reaches the k-th best lower
    bound of its chunk, then of all chunks. Exact vectors are read in order of
    bounds: those of the k best upper bounds first, then those whose upper bound
    reaches the k-th exact score. No other row can be among the k best. Nothing
    of a query meets in one task but k rows from each chunk.

    Ties go to the smaller id; fewer than k other rows give all of them. Rows
    without an id or a whole vector take no part; shorter vectors end in zeros.
    Of rows that repeat an id the one of the least vector counts, as a query
    too. Components count as 2**61 at most, scores as the least or largest long.
    """
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = materialise(integer_vectors(df, id_col, vector_col, scale), "every")
    asked = df.filter(is_query & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct()
    file, lows, widths = build_file(every, k, bits)
    queries = materialise(every.join(asked, "id").mapInArrow(_packed(len(lows)), "q long, query binary"), "queries")
    drop(every)
    n_blocks, n_chunks = max(1, -(-queries.count() // block)), max(1, -(-file.count() // chunk))
    n_chunks = max(n_chunks, min(spread, -(-file.count() // _STEP)) // n_blocks, 1)  # enough tasks for few rows
    part = lambda key, n, seed: F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(part("q", n_blocks, 1).alias("a"), upto(n_chunks).alias("b"), F.lit(0).alias("side"), F.col("q").alias("id"), F.col("query").alias("data"))
    right = file.select(upto(n_blocks).alias("a"), part("id", n_chunks, 2).alias("b"), F.lit(1).alias("side"), "id", F.col("cells").alias("data"))
    met = left.unionByName(right).repartition(min(spread, n_blocks * n_chunks), "a", "b").sortWithinPartitions("a", "b", "side", "id")
    near = materialise(met.mapInArrow(_scan(lows, widths, k, bits), "q long, id long, upper double, lower double"), "bounds")
    least = _kth(near, "lower", k).withColumnRenamed("kth", "least")
    near = near.join(least, "q", "left").filter(F.col("least").isNull() | (F.col("upper") >= F.col("least"))).select("q", "id", "upper")
    near = materialise(near, "near")
    vectors = file.select("id", "vector")

    def exact(some: DataFrame) -> DataFrame:
        return some.select("q", "id").join(vectors, "id").join(queries, "q").select("q", "id", _score("query", "vector").alias("score"))

    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("upper"), "id"))
    first = materialise(exact(near.withColumn("nth", nth).filter(F.col("nth") <= k)), "first")  # tasks send k rows a query
    certain = _kth(first, "score", k)
    open_ = near.join(certain, "q").filter(F.col("upper") >= F.col("kth"))  # fewer than k have no rest
    rest = open_.join(first.select("q", "id"), ["q", "id"], "left_anti")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    ranked = first.unionByName(exact(rest)).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    out = materialise(ranked.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score"), "topk")
    for done in (file, queries, near, first):
        drop(done)
    return out


def _kth(rows: DataFrame, value: str, k: int) -> DataFrame:
    """(q, kth): the k-th largest value of each q that has so many; k rows a task and q are shuffled."""
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(value), "id"))
    top = rows.select("q", "id", value).withColumn("n", nth).filter(F.col("n") <= k)
    return top.groupBy("q").agg(F.min(value).alias("kth"), F.count("*").alias("n")).filter(F.col("n") == k).select("q", "kth")


def _packed(width: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([v.tobytes() for v in _dense(batch["vector"], width)], pa.binary())], ["q", "query"])

    return run


def _bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(upper, lower) bounds of the products of all queries with all vectors between low and high."""
    q, lo, hi = queries.astype(float), low.astype(float), high.astype(float)
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    upper, lower = plus @ hi.T + minus @ lo.T, plus @ lo.T + minus @ hi.T
    if q.size and lo.size and np.abs(q).max() * max(np.abs(lo).max(), np.abs(hi).max()) * q.shape[1] >= 2**53:  # sums may be rounded
        slack = 1e-12 * (np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)).T)
        upper, lower = upper + slack, lower - slack
    return np.clip(upper, -(2.0**63), 2.0**63), np.clip(lower, -(2.0**63), 2.0**63)


def _scan(lows: np.ndarray, widths: np.ndarray, k: int, bits: int):
    """Rows sorted by (a, b, side): the queries of a block, then the cells of a chunk as they stream in."""

    def candidates(held: list[tuple[np.ndarray, ...]], best: np.ndarray) -> tuple[np.ndarray, ...]:
        q, v, upper, lower = (np.concatenate(x) for x in zip(*held, strict=True))
        keep = upper >= best.min(1)[q]
        return q[keep], v[keep], upper[keep], lower[keep]

    def batch_of(ids: np.ndarray, held: list[tuple[np.ndarray, ...]], best: np.ndarray) -> pa.RecordBatch:
        q, v, upper, lower = candidates(held, best)
        return pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(v), pa.array(upper), pa.array(lower)], ["q", "id", "upper", "lower"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, ids, queries, best, held = None, [], None, None, None, []
        for batch in it:
            if not batch.num_rows:
                continue
            keys = np.stack([batch[c].to_numpy() for c in ("a", "b", "side")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if tuple(keys[lo, :2]) != key:
                    if held:
                        yield batch_of(ids, held, best)
                    key, parts, ids, held = tuple(keys[lo, :2]), [], None, []
                some = batch.slice(lo, hi - lo)
                if keys[lo, 2] == 0:
                    parts.append(some)
                    continue
                if ids is None and parts:
                    block = pa.Table.from_batches(parts).combine_chunks()
                    ids, queries = block["id"].to_numpy(), _dense(block["data"].combine_chunks(), len(lows))
                    best = np.full((len(ids), k), -np.inf)
                for at in range(0, some.num_rows if ids is not None else 0, _STEP):
                    step = some.slice(at, _STEP)
                    names = step["id"].to_numpy()
                    cells = np.stack([np.frombuffer(c.as_py(), np.uint8 if bits <= 8 else np.uint16) for c in step["data"]])
                    low = cells.astype(np.int64) * widths + lows
                    upper, lower = _bounds(queries, low, low + (widths - 1))
                    own = ids[:, None] == names[None, :]
                    upper[own], lower[own] = -np.inf, -np.inf
                    both = np.concatenate((best, lower), 1)
                    best = np.partition(both, both.shape[1] - k, 1)[:, -k:]
                    q, v = np.nonzero((upper >= best.min(1)[:, None]) & (upper > -np.inf))
                    held.append((q, names[v], upper[q, v], lower[q, v]))
                    if sum(len(h[0]) for h in held) > _HELD:
                        held = [candidates(held, best)]
                        if len(held[0][0]) > _HELD // 2:  # bounds that tell little: send them on
                            yield batch_of(ids, held, best)
                            held = []
        if held:
            yield batch_of(ids, held, best)

    return run


@F.arrow_udf(T.LongType())
def _score(query: pa.Array, vector: pa.Array) -> pa.Array:
    """Inner products of rows of packed integers, exact; beyond 64 bits the least or largest long."""
    if not len(query):
        return pa.array([], pa.int64())
    a, b = _dense(query), _dense(vector)
    if a.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**62:
        return pa.array((a * b).sum(1))
    sums = [sum(x * y for x, y in zip(p, q, strict=True)) for p, q in zip(a.tolist(), b.tolist(), strict=True)]
    return pa.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in sums], pa.int64())


def op9_vectors(spark, sf_dir: str) -> DataFrame:
    """The 5 best of all rows for each row whose id is divisible by 50."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows.select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
