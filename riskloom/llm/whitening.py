"""Whitened embeddings from leading components of their covariance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.scratch import drop, materialise

#: Integers count as this at most, so that sums of two fit 64 bits.
_LIMIT = 1 << 61
_LONG = (1 << 63) - 1


def whole_numbers(df: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """id and x = floor(scale * c) + shift of vectors without null or non-finite entries; shorter vectors end in entries 0."""
    whole = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    number = lambda c: F.least(F.greatest(F.floor(c.cast("double") * scale).cast("long"), F.lit(-_LIMIT)), F.lit(_LIMIT)) + F.lit(shift).cast("long")
    rows = df.filter(whole).select(F.col(id_col).alias("id"), F.transform(vector_col, number).alias("x"))
    sizes = rows.agg(F.max(F.size("x")), F.min(F.size("x"))).first()
    width = sizes[0] or 0
    if sizes[1] == width:
        return rows
    return rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(shift).cast("long"), F.lit(width) - F.size("x"))))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _summed(rows: DataFrame, column: str, of: Callable[[np.ndarray], np.ndarray], exact: bool = False) -> list:
    """Sum of of(x) over batches x of rows, each task's first added up in the task.

    of gives an array of a fixed shape; what the driver gets has that shape,
    however many rows there are. Exact sums, of whole numbers of any size, go
    through Spark in limbs of 40 bits.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in it:
            if batch.num_rows:
                some = of(_matrix(batch[column])).ravel()
                some = some.astype(object) if exact else some
                total = some if total is None else total + some
        if total is None:
            return
        told = [(i, j, v) for i, t in enumerate(total) for j, v in enumerate(_limbs(int(t)))] if exact else [(i, 0, v) for i, v in enumerate(total)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*told, strict=True)], ["i", "j", "v"])

    parts = rows.select(column).mapInArrow(run, f"i long, j long, v {'long' if exact else 'double'}")
    out = parts.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)") if exact else F.col("v")).alias("v")).collect()
    sums: dict[int, float] = {}
    for r in sorted(out):
        sums[r.i] = sums.get(r.i, 0) + (int(r.v) << _LIMB * r.j if exact else r.v)
    return list(sums.values())


_LIMB = 40


def _limbs(number: int) -> list[int]:
    """Parts of _LIMB bits from the lowest up; the last has the sign."""
    out = []
    while not -(1 << _LIMB) < number < 1 << _LIMB:
        out.append(number & ((1 << _LIMB) - 1))
        number >>= _LIMB
    return [*out, number]


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums S a dimension; components as columns, by falling eigenvalue; shares of the variance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    shares: np.ndarray
    identity_error: float
    passes: int


def _centre(n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The mean as a whole number and a rest of at most a half, so that centring loses no digits."""
    near = [(2 * s + n) // (2 * n) for s in sums]
    rest = [(s - m * n) / n for s, m in zip(sums, near, strict=True)]
    return np.array(near, np.int64), np.array(rest)


def _centred(x: np.ndarray, near: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (x - near).astype(float) - rest


def block_lanczos(times: Callable[[np.ndarray], np.ndarray], dims: int, k: int, block: int, tol: float = 1e-13, seed: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """(values, vectors, passes): the k leading eigenpairs of a symmetric operator that is only known by times(V).

    The basis grows by a block a pass. Each new block is made orthogonal to all
    of the basis, twice. Directions that vanish (breakdown: the basis spans an
    invariant space) are replaced by random ones, orthogonal to the basis. It
    ends when the residual of each of the k leading Ritz pairs is at most tol
    times the largest Ritz value, or when the basis spans all dimensions. Only
    dims x basis numbers are held, no rows.
    """
    rng = np.random.default_rng(seed)
    k = min(k, dims)
    basis, images = np.zeros((dims, 0)), np.zeros((dims, 0))
    new = rng.standard_normal((dims, min(block, dims)))
    passes = 0
    while True:
        new = _orthogonal(new, basis, rng)
        basis = np.concatenate((basis, new), 1)
        images = np.concatenate((images, times(new)), 1)
        passes += 1
        small = basis.T @ images
        values, inner = np.linalg.eigh((small + small.T) / 2)
        values, inner = values[::-1], inner[:, ::-1]
        if basis.shape[1] >= k:
            vectors = basis @ inner[:, :k]
            residual = np.linalg.norm(images @ inner[:, :k] - vectors * values[:k], axis=0)
            if basis.shape[1] == dims or (residual <= tol * max(abs(values[0]), np.finfo(float).tiny)).all():
                return values[:k], np.linalg.qr(vectors)[0] * np.sign(np.diag(np.linalg.qr(vectors)[1])), passes
        new = images[:, -new.shape[1] :][:, : dims - basis.shape[1]]


def _orthogonal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Unit columns orthogonal to the basis and each other; random ones where a column has nothing of its own."""
    out = basis
    for i in range(block.shape[1]):
        v = block[:, i]
        scale = np.linalg.norm(v)
        while True:
            for _ in range(2):
                v = v - out @ (out.T @ v)
            size = np.linalg.norm(v)
            if size > 1e-10 * scale:
                break
            v = rng.standard_normal(len(v))
            scale = np.linalg.norm(v)
        v = v / size
        v = v - out @ (out.T @ v)
        out = np.concatenate((out, (v / np.linalg.norm(v))[:, None]), 1)
    return out[:, basis.shape[1] :]


def fit_whitening(vectors: DataFrame, k: int = 16, column: str = "x") -> Whitening | None:
    """Fit on all rows of vectors (whole numbers in lists of one length); None without any.

    Each pass over the rows adds up (X - mean)'(X - mean)V for a block V of k
    columns. Components whose eigenvalue is 0 next to the trace are left out, so
    fewer distinct vectors than k give fewer components.
    """
    n = vectors.count()
    if not n:
        return None
    sums = tuple(_summed(vectors, column, lambda x: x.astype(object).sum(0) if np.abs(x).max() > 1 << 40 else x.sum(0), exact=True))
    near, rest = _centre(n, sums)
    # as whole numbers: the trace is exact before its one division
    spread = _summed(vectors, column, _squares(n, sums), exact=True)[0]
    trace = spread / n**3
    if not spread:
        return Whitening(n, sums, np.zeros((len(sums), 0)), np.zeros(0), np.zeros(0), 0.0, 0)

    def times(v: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            y = _centred(x, near, rest)
            return y.T @ (y @ v)

        return np.array(_summed(vectors, column, of)).reshape(v.shape) / n

    values, components, passes = block_lanczos(times, len(sums), k, k)
    real = values > 1e-12 * trace
    values, components = values[real], components[:, real]

    def covariance(x: np.ndarray) -> np.ndarray:
        z = _centred(x, near, rest) @ components / np.sqrt(values)
        return z.T @ z

    seen = np.array(_summed(vectors, column, covariance)).reshape(len(values), -1) / n
    error = float(np.abs(seen - np.eye(len(values))).max())
    return Whitening(n, sums, components, values, values / trace, error, passes)


def _squares(n: int, sums: tuple[int, ...]) -> Callable[[np.ndarray], np.ndarray]:
    """One number: the sum of all rows' deviations, exact."""

    def of(x: np.ndarray) -> np.ndarray:
        return np.array([sum(_deviations(x, n, sums))], object)

    return of


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """Sum over dimensions of (n * x - S)**2 of each row, exact; in whole numbers of any size where 64 bits are too few."""
    near = [(2 * s + n) // (2 * n) for s in sums]
    less = x - np.array(near, np.int64)  # n * x - S = n * (x - near) - (S - n * near)
    rest = [s - m * n for s, m in zip(sums, near, strict=True)]
    most = (int(np.abs(less).max(initial=0)) + 1) * n
    if most * most * max(1, x.shape[1]) < _LONG:
        y = less * n - np.array(rest, np.int64)
        return (y * y).sum(1).tolist()
    y = less.astype(object) * n - np.array(rest, object)
    return [int(v) for v in (y * y).sum(1)]


def whiten(df: DataFrame, k: int = 16, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """id, deviation, whitened (list of up to k numbers), n, explained (list), identity_error of each row with a whole vector.

    Entries count as floor(scale * c) + shift. The mean and the components come
    from the distinct vectors, each once, and all rows are projected on them.
    Null vectors and such with null or non-finite entries are dropped; null and
    repeated ids stay; shorter vectors end in entries 0; entries beyond 2**61
    count as that; deviations beyond 64 bits as the largest long. Vectors that
    are all equal, or an empty table, give no rows, as nothing can be whitened.
    Of several equal eigenvalues any basis may come out, the same for all rows.
    """
    rows = materialise(whole_numbers(df, id_col, vector_col, scale, shift), "numbers")
    fit_list = materialise(rows.select("x").distinct(), "fit")
    model = fit_whitening(fit_list, k)
    drop(fit_list)
    types = f"id {rows.schema['id'].dataType.simpleString()}, deviation long, whitened array<double>"
    if model is None or not len(model.values):
        drop(rows)
        lone = df.sparkSession.createDataFrame([], types)
        n, shares, error = 0, [], 0.0
    else:
        n, shares, error = model.n, model.shares.tolist(), model.identity_error
        lone = rows.mapInArrow(_projected(model), types)
    constants = F.array(*(F.lit(s) for s in shares)).cast("array<double>")
    return lone.select(F.col("id").alias(id_col), "deviation", "whitened", F.lit(n).cast("long").alias("n"), constants.alias("explained"), F.lit(error).alias("identity_error"))


def _projected(model: Whitening):
    near, rest = _centre(model.n, model.sums)
    onto = model.components / np.sqrt(model.values)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            x = _matrix(batch["x"])
            away = pa.array([min(d, _LONG) for d in _deviations(x, model.n, model.sums)], pa.int64())
            z = _centred(x, near, rest) @ onto
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch["id"], away, lists], ["id", "deviation", "whitened"])

    return run


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """16 whitened components of every embedding."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    long = whiten(rows).select("vec_id", "n", "deviation", F.posexplode("whitened").alias("at", "whitened"), "explained", "identity_error")
    share = F.get("explained", F.col("at"))
    return long.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", share.alias("explained"), "identity_error")
