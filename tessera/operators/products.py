"""Products and contractions as joins and aggregates, and structured linear operators.

A contraction joins the operands on the contracted axes and sums by the axes that
stay. Cells that are zero may be left out before the join if the other operand is
finite, which makes structured and sparse matrices cheap.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import functions as F

from tessera.operators.array import NdArray, _coordinates, axis_names, broadcast_to, broadcast_shapes, expand_dims, meet, ravel, reshape, squeeze, transpose


def _renumbered(a: NdArray, prefix: str):
    return a.cells.select(*[F.col(n).alias(f"{prefix}{k}") for k, n in enumerate(a.axes)], F.col("v").alias(f"{prefix}v"))


def tensordot(a: NdArray, b: NdArray, axes=2, sparse: bool = False) -> NdArray:
    """Contract pairs of axes. sparse: leave zeros out (both operands must be finite)."""
    left, right = (list(range(a.ndim - axes, a.ndim)), list(range(axes))) if isinstance(axes, int) else ([axes[0]] if isinstance(axes[0], int) else list(axes[0]), [axes[1]] if isinstance(axes[1], int) else list(axes[1]))
    left, right = [a.axis(k) for k in left], [b.axis(k) for k in right]
    if [a.shape[k] for k in left] != [b.shape[k] for k in right]:
        raise ValueError("shape-mismatch for sum")
    rest_a, rest_b = [k for k in range(a.ndim) if k not in left], [k for k in range(b.ndim) if k not in right]
    x, y = _renumbered(a, "a"), _renumbered(b, "b")
    if sparse:
        x, y = x.where("av != 0"), y.where("bv != 0")
    on = reduce(lambda p, q: p & q, [F.col(f"a{i}") == F.col(f"b{j}") for i, j in zip(left, right)]) if left else []
    joined = meet(x, y, on, a.size, b.size, a.size * b.size // max(1, math.prod(a.shape[k] for k in left)))
    out = [*[F.col(f"a{k}") for k in rest_a], *[F.col(f"b{k}") for k in rest_b]]
    shape = tuple([a.shape[k] for k in rest_a] + [b.shape[k] for k in rest_b])
    names = [c.alias(n) for c, n in zip(out, axis_names(len(out)))]
    found = joined.groupBy(*names).agg(F.sum(F.col("av") * F.col("bv")).alias("v")) if names else joined.agg(F.coalesce(F.sum(F.col("av") * F.col("bv")), F.lit(0.0)).alias("v"))
    if sparse and names:
        zero = _coordinates(a.spark, shape, lambda c: F.lit(0.0)).cells.drop("v")
        found = zero.join(found, axis_names(len(shape)), "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    return NdArray(found, shape)


def dot(a: NdArray, b: NdArray) -> NdArray:
    if a.ndim == 0 or b.ndim == 0:
        return a.zip(b, lambda x, y: x * y)
    return tensordot(a, b, ([a.ndim - 1], [0 if b.ndim == 1 else b.ndim - 2]))


def vdot(a: NdArray, b: NdArray) -> NdArray:
    return tensordot(ravel(a), ravel(b), 1)


def inner(a: NdArray, b: NdArray) -> NdArray:
    return tensordot(a, b, ([a.ndim - 1], [b.ndim - 1]))


def matmul(a: NdArray, b: NdArray, sparse: bool = False) -> NdArray:
    """The matrix product over the last two axes; leading axes are batches and broadcast."""
    if a.ndim == 1 and b.ndim == 1:
        return inner(a, b)
    if a.ndim == 1:
        return squeeze(matmul(expand_dims(a, 0), b, sparse), -2)
    if b.ndim == 1:
        return squeeze(matmul(a, expand_dims(b, 1), sparse), -1)
    if a.ndim == 2 and b.ndim == 2:
        return tensordot(a, b, 1, sparse)
    batch = broadcast_shapes(a.shape[:-2], b.shape[:-2])
    if a.shape[-1] != b.shape[-2]:
        raise ValueError("matmul: mismatch in the core dimension")
    a, b = broadcast_to(a, (*batch, *a.shape[-2:])), broadcast_to(b, (*batch, *b.shape[-2:]))
    n = len(batch)
    on = [F.col(f"a{k}") == F.col(f"b{k}") for k in range(n)] + [F.col(f"a{n + 1}") == F.col(f"b{n}")]
    joined = meet(_renumbered(a, "a"), _renumbered(b, "b"), reduce(lambda p, q: p & q, on), a.size, b.size, a.size * b.shape[-1])
    keys = [*[F.col(f"a{k}").alias(f"i{k}") for k in range(n)], F.col(f"a{n}").alias(f"i{n}"), F.col(f"b{n + 1}").alias(f"i{n + 1}")]
    return NdArray(joined.groupBy(*keys).agg(F.sum(F.col("av") * F.col("bv")).alias("v")), (*batch, a.shape[-2], b.shape[-1]))


def vecdot(a: NdArray, b: NdArray) -> NdArray:
    from tessera.operators.reduce import sum_

    return sum_(a.zip(b, lambda x, y: x * y), -1)


def matvec(a: NdArray, x: NdArray) -> NdArray:
    return squeeze(matmul(a, expand_dims(x, -1)), -1) if x.ndim > 1 else matmul(a, x)


def vecmat(x: NdArray, a: NdArray) -> NdArray:
    return squeeze(matmul(expand_dims(x, -2), a), -2) if x.ndim > 1 else matmul(x, a)


def outer(a: NdArray, b: NdArray) -> NdArray:
    a, b = ravel(a), ravel(b)
    return expand_dims(a, 1).zip(expand_dims(b, 0), lambda x, y: x * y)


def kron(a: NdArray, b: NdArray) -> NdArray:
    n = max(a.ndim, b.ndim)
    a, b = reshape(a, (1,) * (n - a.ndim) + a.shape), reshape(b, (1,) * (n - b.ndim) + b.shape)
    both = tensordot(a, b, 0)
    keys = [(F.col(f"i{k}") * b.shape[k] + F.col(f"i{n + k}")).alias(f"i{k}") for k in range(n)]
    return NdArray(both.cells.select(*keys, "v"), tuple(x * y for x, y in zip(a.shape, b.shape)))


def cross(a: NdArray, b: NdArray) -> NdArray:
    """Of 3-vectors along the last axis."""
    name = f"i{a.ndim - 1}"
    lanes = [x for x in a.axes if x != name]
    pick = lambda x, p: x.cells.groupBy(*lanes).agg(*[F.max(F.when(F.col(name) == k, F.col("v"))).alias(f"{p}{k}") for k in range(3)])
    x, y = pick(a, "x"), pick(b, "y")
    both = x.join(y, lanes) if lanes else x.crossJoin(y)
    part = lambda i, j: F.col(f"x{i}") * F.col(f"y{j}") - F.col(f"x{j}") * F.col(f"y{i}")
    return NdArray(both.select(*lanes, F.posexplode(F.array(part(1, 2), part(2, 0), part(0, 1))).alias(name, "v")).withColumn(name, F.col(name).cast("long")).select(*a.axes, "v"), a.shape)


def trace(a: NdArray, offset: int = 0) -> NdArray:
    from tessera.operators.array import diagonal
    from tessera.operators.reduce import sum_

    return sum_(diagonal(a, offset, -2, -1) if a.ndim > 2 else diagonal(a, offset), -1)


def chain_order(shapes: list[tuple[int, int]]):
    """The cheapest order of a chain of matrix products, as nested pairs of numbers."""
    n = len(shapes)
    best = {(i, i): (0, i) for i in range(n)}
    for size in range(1, n):
        for i in range(n - size):
            j = i + size
            best[i, j] = min(((best[i, k][0] + best[k + 1, j][0] + shapes[i][0] * shapes[k][1] * shapes[j][1], (best[i, k][1], best[k + 1, j][1])) for k in range(i, j)), key=lambda x: x[0])
    return best[0, n - 1][1]


def multi_dot(arrays: list[NdArray]) -> NdArray:
    def run(node):
        return arrays[node] if isinstance(node, int) else matmul(run(node[0]), run(node[1]))

    return run(chain_order([a.shape for a in arrays]))


def matrix_power(a: NdArray, n: int) -> NdArray:
    if n == 0:
        return _coordinates(a.spark, a.shape, lambda c: F.when(c[0] == c[1], 1.0).otherwise(0.0))
    if n < 0:
        from tessera.operators.linalg import inv

        return matrix_power(inv(a), -n)
    out, square = None, a
    while n:
        if n & 1:
            out = square if out is None else matmul(out, square)
        n >>= 1
        square = matmul(square, square) if n else square
    return out


# --- structured operators ------------------------------------------------------


@dataclass(frozen=True)
class Diagonal:
    """A diagonal matrix, kept as its diagonal."""

    d: NdArray

    @property
    def shape(self):
        return (self.d.size, self.d.size)

    def apply(self, x: NdArray) -> NdArray:
        return self.d.zip(x, lambda a, b: a * b) if x.ndim == 1 else expand_dims(self.d, 1).zip(x, lambda a, b: a * b)

    def to_dense(self) -> NdArray:
        from tessera.operators.array import diag

        return diag(self.d)


@dataclass(frozen=True)
class Toeplitz:
    """Constant diagonals: t[d + n - 1] is the value where i - j is d."""

    t: NdArray
    n: int

    @property
    def shape(self):
        return (self.n, self.n)

    def apply(self, x: NdArray) -> NdArray:
        n = self.n
        pairs = x.cells.select(F.col("i0").alias("j"), F.col("v").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("i"))
        joined = pairs.withColumn("d", F.col("i") - F.col("j") + n - 1).join(self.t.cells.select(F.col("i0").alias("d"), "v"), "d")
        return NdArray(joined.groupBy(F.col("i").alias("i0")).agg(F.sum(F.col("x") * F.col("v")).alias("v")), (n,))

    def to_dense(self) -> NdArray:
        cells = _coordinates(self.t.spark, self.shape, lambda c: F.lit(0)).cells.withColumn("d", F.col("i0") - F.col("i1") + self.n - 1).drop("v")
        return NdArray(cells.join(self.t.cells.select(F.col("i0").alias("d"), "v"), "d").select("i0", "i1", "v"), self.shape)


@dataclass(frozen=True)
class Circulant:
    """Wrapped constant diagonals, given by the first column. Products of circulants are circulants."""

    c: NdArray

    @property
    def shape(self):
        return (self.c.size, self.c.size)

    def apply(self, x: NdArray) -> NdArray:
        """A convolution: by FFT on one executor's lane, O(n log n)."""
        from tessera.operators.lanes import convolved

        return convolved(self.c, x)

    def to_dense(self) -> NdArray:
        n = self.c.size
        cells = _coordinates(self.c.spark, self.shape, lambda c: F.lit(0)).cells.withColumn("d", F.pmod(F.col("i0") - F.col("i1"), F.lit(n))).drop("v")
        return NdArray(cells.join(self.c.cells.select(F.col("i0").alias("d"), "v"), "d").select("i0", "i1", "v"), self.shape)


@dataclass(frozen=True)
class LowRank:
    """U times V transposed."""

    u: NdArray
    v: NdArray

    @property
    def shape(self):
        return (self.u.shape[0], self.v.shape[0])

    def apply(self, x: NdArray) -> NdArray:
        return matmul(self.u, matmul(transpose(self.v), x))

    def to_dense(self) -> NdArray:
        return matmul(self.u, transpose(self.v))


@dataclass(frozen=True)
class Dense:
    a: NdArray

    @property
    def shape(self):
        return self.a.shape

    def apply(self, x: NdArray) -> NdArray:
        return matmul(self.a, x)

    def to_dense(self) -> NdArray:
        return self.a


@dataclass(frozen=True)
class Product:
    """A product that is applied factor by factor, from the right."""

    left: object
    right: object

    @property
    def shape(self):
        return (self.left.shape[0], self.right.shape[1])

    def apply(self, x: NdArray) -> NdArray:
        return self.left.apply(self.right.apply(x))

    def to_dense(self) -> NdArray:
        return matmul(self.left.to_dense(), self.right.to_dense())


def compose(a, b):
    """The product of two structured operators, in closed form where there is one."""
    if isinstance(a, Diagonal) and isinstance(b, Diagonal):
        return Diagonal(a.d.zip(b.d, lambda x, y: x * y))
    if isinstance(a, Circulant) and isinstance(b, Circulant):
        return Circulant(a.apply(b.c))
    if isinstance(a, LowRank) and isinstance(b, LowRank):
        return LowRank(matmul(a.u, matmul(transpose(a.v), b.u)), b.v)
    return Product(a, b)


def is_diagonal(a: NdArray, tol: float = 0.0) -> bool:
    return not a.cells.where((F.col("i0") != F.col("i1")) & (F.abs("v") > tol)).limit(1).count()


def _constant_along(a: NdArray, key, tol: float) -> bool:
    spread = a.cells.groupBy(key.alias("d")).agg((F.max("v") - F.min("v")).alias("s")).agg(F.max("s")).first()[0]
    return spread is not None and spread <= tol


def is_toeplitz(a: NdArray, tol: float = 0.0) -> bool:
    return _constant_along(a, F.col("i0") - F.col("i1"), tol)


def is_circulant(a: NdArray, tol: float = 0.0) -> bool:
    return _constant_along(a, F.pmod(F.col("i0") - F.col("i1"), F.lit(a.shape[0])), tol)


def qr_orthonormal(a: NdArray) -> NdArray:
    """Orthonormal columns that span those of a tall matrix: by the Cholesky factor of its Gramian, twice for accuracy."""
    import numpy as np

    from tessera.operators.array import array

    for _ in range(2):
        gram = np.array(matmul(transpose(a), a).tolist(), float)  # a cell a pair of columns
        upper = np.linalg.cholesky(gram).T
        a = matmul(a, array(a.spark, np.linalg.inv(upper).tolist()))
    return a


def detect_lowrank(a: NdArray, most: int = 32, tol: float = 1e-10, seed: int = 0):
    """A LowRank operator if the matrix has a rank of `most` at most (up to tol of its norm), else None.

    A randomised range finder: products with a few seeded random vectors span the range, an orthonormal
    basis of them is one factor, its product with the matrix the other, and the residual decides. The sketch
    and the factors are work tables, so the matrix is computed three times whatever is done with the factors.
    """
    import numpy as np

    from tessera.operators.array import array, kept

    k = min(most + 4, *a.shape)
    probes = array(a.spark, np.random.default_rng(seed).normal(size=(a.shape[1], k)).tolist())
    sketch = kept(matmul(a, probes), "sketch")
    values, vectors = np.linalg.eigh(np.array(matmul(transpose(sketch), sketch).tolist(), float))  # k by k, whatever the matrix
    some = values > max(values[-1], 0) * 1e-14
    rank = int(some.sum())
    if rank == 0 or rank > most:
        return None
    basis = kept(matmul(sketch, array(a.spark, (vectors[:, some] / np.sqrt(values[some])).tolist())), "basis")
    rest = kept(matmul(transpose(basis), a), "rest")
    both = a.zip(matmul(basis, rest), lambda x, y: F.struct(((x - y) * (x - y)).alias("left"), (x * x).alias("all")))
    left, whole = both.cells.agg(F.sum("v.left"), F.sum("v.all")).first()
    return LowRank(basis, transpose(rest)) if left <= tol * whole else None


def certify(operator, a: NdArray, x: NdArray, most: float = 1e-9) -> float:
    """The greatest error of an operator against the plain product with its matrix; an error above `most` is refused."""
    from tessera.operators.reduce import max_

    error = max_(operator.apply(x).zip(matvec(a, x), lambda p, q: F.abs(p - q))).item()
    if not error < most:
        raise ValueError(f"the operator differs from its matrix by {error}")
    return error


def detect(a: NdArray, tol: float = 1e-12):
    """The simplest structure of a square matrix: diagonal, circulant, Toeplitz, of low rank, or dense."""
    from tessera.operators.array import diagonal, take_index

    if is_diagonal(a, tol):
        return Diagonal(diagonal(a))
    if is_circulant(a, tol):
        return Circulant(take_index(a, 0, 1))
    if is_toeplitz(a, tol):
        n = a.shape[0]
        edge = a.cells.where("i0 = 0 OR i1 = 0").select((F.col("i0") - F.col("i1") + n - 1).alias("i0"), "v")
        return Toeplitz(NdArray(edge, (2 * n - 1,)), n)
    return detect_lowrank(a, max(1, min(32, a.shape[0] // 4))) or Dense(a)
