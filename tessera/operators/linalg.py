"""Linear algebra: matrices over the last two axes, one task for each matrix of a batch.

Tall matrices that no task can hold have their own ways: `gram`, `lstsq_tall` and
`svd_tall` work from the Gramian, an aggregate over rows whose size is that of the columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.array import NdArray, concatenate, diagonal, expand_dims, matrix_transpose, moveaxis, ravel, reshape, squeeze  # noqa: F401
from tessera.operators.lanes import blocks
from tessera.operators.products import cross, matmul, matrix_power, multi_dot, outer, tensordot, trace, vecdot  # noqa: F401

LinAlgError = np.linalg.LinAlgError


def _square(a: NdArray) -> int:
    if a.ndim < 2 or a.shape[-1] != a.shape[-2]:
        raise LinAlgError("Last 2 dimensions of the array must be square")
    return a.shape[-1]


def det(a: NdArray) -> NdArray:
    _square(a)
    return blocks(a, 2, np.linalg.det, ())


def slogdet(a: NdArray) -> tuple[NdArray, NdArray]:
    _square(a)
    both = blocks(a, 2, lambda m: np.array(np.linalg.slogdet(m)), (2,))
    return both[..., 0], both[..., 1]


def inv(a: NdArray) -> NdArray:
    n = _square(a)
    return blocks(a, 2, np.linalg.inv, (n, n))


def solve(a: NdArray, b: NdArray) -> NdArray:
    """b: a vector or a matrix for each matrix of a."""
    n = _square(a)
    vector = b.ndim == a.ndim - 1
    b = expand_dims(b, -1) if vector else b
    both = concatenate([a, b], -1)
    out = blocks(both, 2, lambda m: np.linalg.solve(m[:, :n], m[:, n:]), (n, b.shape[-1]))
    return squeeze(out, -1) if vector else out


def cholesky(a: NdArray, upper: bool = False) -> NdArray:
    n = _square(a)
    return blocks(a, 2, lambda m: np.linalg.cholesky(m).T if upper else np.linalg.cholesky(m), (n, n))


def eigvals(a: NdArray) -> NdArray:
    n = _square(a)
    return blocks(a, 2, lambda m: np.linalg.eigvals(m).astype(complex), (n,), True)


def eig(a: NdArray) -> tuple[NdArray, NdArray]:
    n = _square(a)
    return eigvals(a), blocks(a, 2, lambda m: np.linalg.eig(m)[1].astype(complex), (n, n), True)


def eigvalsh(a: NdArray, uplo: str = "L") -> NdArray:
    n = _square(a)
    return blocks(a, 2, lambda m: np.linalg.eigvalsh(m, uplo), (n,))


def eigh(a: NdArray, uplo: str = "L") -> tuple[NdArray, NdArray]:
    n = _square(a)
    return eigvalsh(a, uplo), blocks(a, 2, lambda m: np.linalg.eigh(m, uplo)[1], (n, n))


def qr(a: NdArray, mode: str = "reduced"):
    m, n = a.shape[-2:]
    k = m if mode == "complete" else min(m, n)
    r = blocks(a, 2, lambda x: np.linalg.qr(x, "complete" if mode == "complete" else "reduced")[1], (k, n))
    return r if mode == "r" else (blocks(a, 2, lambda x: np.linalg.qr(x, mode)[0], (m, k)), r)


def svdvals(a: NdArray) -> NdArray:
    return blocks(a, 2, lambda x: np.linalg.svd(x, compute_uv=False), (min(a.shape[-2:]),))


def svd(a: NdArray, full_matrices: bool = True, compute_uv: bool = True):
    if not compute_uv:
        return svdvals(a)
    m, n = a.shape[-2:]
    k = min(m, n)
    part = lambda i: lambda x: np.linalg.svd(x, full_matrices)[i]
    return blocks(a, 2, part(0), (m, m if full_matrices else k)), svdvals(a), blocks(a, 2, part(2), (n if full_matrices else k, n))


def pinv(a: NdArray, rcond: float | None = None) -> NdArray:
    m, n = a.shape[-2:]
    return blocks(a, 2, lambda x: np.linalg.pinv(x) if rcond is None else np.linalg.pinv(x, rcond), (n, m))


def matrix_rank(a: NdArray, tol: float | None = None) -> NdArray:
    return blocks(a, 2, lambda x: np.linalg.matrix_rank(x, tol), ())


def cond(a: NdArray, p=None) -> NdArray:
    return blocks(a, 2, lambda x: np.linalg.cond(x, p), ())


def lstsq(a: NdArray, b: NdArray) -> NdArray:
    n = a.shape[-1]
    vector = b.ndim == a.ndim - 1
    b = expand_dims(b, -1) if vector else b
    out = blocks(concatenate([a, b], -1), 2, lambda m: np.linalg.lstsq(m[:, :n], m[:, n:], rcond=None)[0], (n, b.shape[-1]))
    return squeeze(out, -1) if vector else out


def tensorinv(a: NdArray, ind: int = 2) -> NdArray:
    front, back = a.shape[:ind], a.shape[ind:]
    n = int(np.prod(back))
    return reshape(inv(reshape(a, (n, n))), (*back, *front))


def tensorsolve(a: NdArray, b: NdArray) -> NdArray:
    n = b.size
    return reshape(solve(reshape(a, (n, n)), ravel(b)), a.shape[b.ndim :])


def vector_norm(a: NdArray, axis=None, ord: float = 2, keepdims: bool = False) -> NdArray:
    from tessera.operators import reduce as R

    size = a.map(lambda v: F.abs(v.cast("double")))
    if ord == np.inf:
        return R.max_(size, axis, keepdims)
    if ord == -np.inf:
        return R.min_(size, axis, keepdims)
    if ord == 0:
        return R.count_nonzero(size, axis, keepdims).astype("double")
    return R.sum_(size.map(lambda v: F.pow(v, F.lit(float(ord)))), axis, keepdims).map(lambda v: F.pow(v, F.lit(1 / ord)))


def matrix_norm(a: NdArray, ord="fro") -> NdArray:
    from tessera.operators import reduce as R

    size = a.map(lambda v: F.abs(v.cast("double")))
    if ord == "fro":
        return R.sum_(size.map(lambda v: v * v), (-2, -1)).map(F.sqrt)
    if ord in (1, -1):
        return (R.max_ if ord == 1 else R.min_)(R.sum_(size, -2), -1)
    if ord in (np.inf, -np.inf):
        return (R.max_ if ord == np.inf else R.min_)(R.sum_(size, -1), -1)
    values = svdvals(a)
    return {"nuc": R.sum_, 2: R.max_, -2: R.min_}[ord](values, -1)


def norm(a: NdArray, ord=None, axis=None, keepdims: bool = False) -> NdArray:
    if axis is None and ord is None:
        return vector_norm(ravel(a))
    if a.ndim == 2 and axis is None:
        return matrix_norm(a, ord)
    return vector_norm(a, axis, 2 if ord is None else ord, keepdims)


# --- tall matrices, rows as arrays ---------------------------------------------


def gram(rows: DataFrame, vector: str) -> np.ndarray:
    """A'A of rows that are arrays: an aggregate of products by pairs of columns, combined before the shuffle."""
    cells = rows.select(F.posexplode(vector).alias("i", "x"), F.col(vector).alias("_v")).select("i", "x", F.posexplode("_v").alias("j", "y"))
    sums = cells.groupBy("i", "j").agg(F.sum(F.col("x").cast("double") * F.col("y").cast("double")).alias("s")).collect()  # columns squared
    n = max((r["i"] for r in sums), default=-1) + 1
    out = np.zeros((n, n))
    for i, j, s in sums:
        out[i, j] = s
    return out


def svd_tall(rows: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors of a tall matrix, from its Gramian."""
    w, v = np.linalg.eigh(gram(rows, vector))
    order = np.argsort(w)[::-1]
    return np.sqrt(np.maximum(w[order], 0)), v[:, order].T


def lstsq_tall(rows: DataFrame, vector: str, target: str) -> np.ndarray:
    """Least squares by the normal equations."""
    both = rows.select(F.concat(F.transform(vector, lambda x: x.cast("double")), F.array(F.col(target).cast("double"))).alias("v"))
    g = gram(both, "v")
    return np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=None)[0]
