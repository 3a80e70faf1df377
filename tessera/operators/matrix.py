"""Matrices: arrays that always have two dimensions, with the matrix product as `*`."""

from __future__ import annotations

from dataclasses import dataclass

from tessera.operators import array as A
from tessera.operators import linalg, products, reduce
from tessera.operators.array import NdArray


@dataclass(frozen=True)
class Matrix:
    a: NdArray

    def __post_init__(self):
        if self.a.ndim > 2:
            raise ValueError("matrix must be 2-dimensional")
        object.__setattr__(self, "a", A.atleast_2d(self.a))

    @property
    def shape(self):
        return self.a.shape

    @property
    def A(self) -> NdArray:
        return self.a

    @property
    def A1(self) -> NdArray:
        return A.ravel(self.a)

    @property
    def T(self) -> Matrix:
        return Matrix(self.a.T)

    H = T

    @property
    def I(self) -> Matrix:  # noqa: E743
        """The inverse, or the pseudo-inverse of a matrix that isn't square."""
        return Matrix(linalg.inv(self.a) if self.shape[0] == self.shape[1] else linalg.pinv(self.a))

    def __mul__(self, other) -> Matrix:
        return Matrix(products.matmul(self.a, other.a)) if isinstance(other, Matrix) else Matrix(self.a * other)

    def __pow__(self, n: int) -> Matrix:
        return Matrix(products.matrix_power(self.a, n))

    def __add__(self, other) -> Matrix:
        return Matrix(self.a + (other.a if isinstance(other, Matrix) else other))

    def __sub__(self, other) -> Matrix:
        return Matrix(self.a - (other.a if isinstance(other, Matrix) else other))

    def __getattr__(self, name: str):
        """sum, mean, std, var, prod, any, all, max, min, ptp, argmax, argmin: the axis stays as one of length 1."""
        found = {"sum": reduce.sum_, "any": reduce.any_, "all": reduce.all_, "max": reduce.max_, "min": reduce.min_}.get(name) or (getattr(reduce, name) if name in ("mean", "std", "var", "prod", "ptp", "argmax", "argmin") else None)
        if found is None:
            raise AttributeError(name)
        return lambda axis=None: found(self.a, axis) if axis is None else Matrix(found(self.a, axis, keepdims=True))

    def tolist(self):
        return self.a.tolist()


def asmatrix(a: NdArray) -> Matrix:
    return Matrix(a)
