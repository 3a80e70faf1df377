"""Polynomials in six bases.

Evaluation at a column is a Column expression: the basis recurrence run over the
coefficients, so a series of any degree is evaluated in generated code. Fits sum the
Gramian over the rows in Spark and solve it on the driver. What concerns coefficients
alone is arithmetic of a few numbers and runs on the driver.
"""

from __future__ import annotations

import numpy as np
from numpy.polynomial import chebyshev, hermite, hermite_e, laguerre, legendre, polynomial, polyutils  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.ufuncs import _d

BASES = {"poly": polynomial, "cheb": chebyshev, "leg": legendre, "lag": laguerre, "herm": hermite, "herme": hermite_e}


def basis_columns(basis: str, x, degree: int) -> list[Column]:
    """The basis functions up to a degree at a column, by their three-term recurrences."""
    x = _d(x)
    out = [F.lit(1.0)]
    if degree >= 1:
        out.append({"lag": 1.0 - x, "herm": 2.0 * x}.get(basis, x))
    for n in range(1, degree):
        p, q = out[n], out[n - 1]
        out.append({
            "poly": lambda: x * p, "cheb": lambda: 2.0 * x * p - q, "leg": lambda: ((2 * n + 1) * x * p - n * q) / (n + 1),
            "lag": lambda: ((2 * n + 1 - x) * p - n * q) / (n + 1), "herm": lambda: 2.0 * x * p - 2.0 * n * q, "herme": lambda: x * p - float(n) * q,
        }[basis]())
    return out


def val(basis: str, x, c) -> Column:
    """A series at a column: backward recurrence (Clenshaw), one multiplication chain."""
    x, c = _d(x), [float(v) for v in np.atleast_1d(c)]
    if basis == "poly":
        out = F.lit(c[-1])
        for v in reversed(c[:-1]):
            out = out * x + v
        return out
    high, higher = F.lit(0.0), F.lit(0.0)
    n = len(c)
    for k in range(n - 1, 0, -1):
        a, b = {
            "cheb": lambda k: (2.0 * x, -1.0), "leg": lambda k: ((2 * k + 1) / (k + 1) * x, -(k + 1) / (k + 2)), "lag": lambda k: ((2 * k + 1 - x) / (k + 1), -(k + 1) / (k + 2)),
            "herm": lambda k: (2.0 * x, -2.0 * (k + 1)), "herme": lambda k: (x, -float(k + 1)),
        }[basis](k)
        high, higher = c[k] + a * high + b * higher, high
    first = {"cheb": x, "leg": x, "lag": 1.0 - x, "herm": 2.0 * x, "herme": x}[basis]
    second = {"cheb": -1.0, "leg": -0.5, "lag": -0.5, "herm": -2.0, "herme": -1.0}[basis]
    return c[0] + first * high + second * higher


def valnd(basis: str, points, c) -> Column:
    """A series in several variables at points given by columns."""
    c = np.asarray(c, float)
    columns = [basis_columns(basis, x, d - 1) for x, d in zip(points, c.shape)]
    out = F.lit(0.0)
    for at in np.ndindex(*c.shape):
        if c[at]:
            term = F.lit(float(c[at]))
            for b, k in zip(columns, at):
                term = term * b[k]
            out = out + term
    return out


val2d = val3d = valnd


def grid(basis: str, axes: list[DataFrame], c) -> DataFrame:
    """A series on the Cartesian grid of one-column frames x0, x1, …; the smaller frames are axes of a grid the caller asked for."""
    frame = axes[0].toDF("x0")
    for k, a in enumerate(axes[1:], 1):
        frame = frame.crossJoin(a.toDF(f"x{k}"))
    return frame.withColumn("v", valnd(basis, [F.col(f"x{k}") for k in range(len(axes))], c))


def vander(basis: str, x, degree: int) -> Column:
    return F.array(*basis_columns(basis, x, degree))


def vander_nd(basis: str, points, degrees) -> Column:
    columns = [basis_columns(basis, x, d) for x, d in zip(points, degrees)]
    out = []
    for at in np.ndindex(*[d + 1 for d in degrees]):
        term = F.lit(1.0)
        for b, k in zip(columns, at):
            term = term * b[k]
        out.append(term)
    return F.array(*out)


def fit(basis: str, frame: DataFrame, x: str, y: str, degree: int, weight: str | None = None) -> np.ndarray:
    """Least squares: the Gramian of the basis and its products with y are sums over the rows."""
    b = basis_columns(basis, F.col(x), degree)
    w = _d(F.col(weight)) * _d(F.col(weight)) if weight else F.lit(1.0)
    n = degree + 1
    sums = [F.sum(w * b[i] * b[j]) for i in range(n) for j in range(i, n)] + [F.sum(w * b[i] * _d(F.col(y))) for i in range(n)]
    found = [float(v) for v in frame.agg(*sums).first()]
    gram, at = np.zeros((n, n)), 0
    for i in range(n):
        for j in range(i, n):
            gram[i, j] = gram[j, i] = found[at]
            at += 1
    return np.linalg.lstsq(gram, np.array(found[at:]), rcond=None)[0]


def weight(basis: str, x) -> Column:
    x = _d(x)
    return {"poly": lambda: F.lit(1.0), "cheb": lambda: 1.0 / (F.sqrt(1.0 + x) * F.sqrt(1.0 - x)), "leg": lambda: F.lit(1.0), "lag": lambda: F.exp(-x), "herm": lambda: F.exp(-x * x), "herme": lambda: F.exp(-0.5 * x * x)}[basis]()


def valfromroots(x, roots) -> Column:
    out = F.lit(1.0)
    for r in roots:
        out = out * (_d(x) - float(r))
    return out


def on_coefficients(basis: str, name: str):
    """The basis' function of coefficients: line, trim, add, sub, mulx, mul, div, pow, der, int, fromroots, companion, roots, gauss, 2poly, poly2, pts1, pts2, interpolate, domain, zero, one, x."""
    full = {"2poly": f"{basis}2poly", "poly2": f"poly2{basis}"}.get(name, f"{basis}{name}")
    return getattr(BASES[basis], full)


def getdomain(frame: DataFrame, x: str) -> tuple[float, float]:
    return tuple(frame.agg(F.min(x), F.max(x)).first())


def mapdomain(x, old, new) -> Column:
    off, scale = polyutils.mapparms(old, new)
    return off + scale * _d(x)


trimseq, as_series, trimcoef, mapparms = polyutils.trimseq, polyutils.as_series, polyutils.trimcoef, polyutils.mapparms
set_default_printstyle = np.polynomial.set_default_printstyle


class Series:
    """A series with domain and window; calling it with a column evaluates it there."""

    def __init__(self, basis: str, coef, domain=None, window=None):
        kind = {"poly": "Polynomial", "cheb": "Chebyshev", "leg": "Legendre", "lag": "Laguerre", "herm": "Hermite", "herme": "HermiteE"}[basis]
        self.basis = basis
        self.inner = coef if hasattr(coef, "coef") else getattr(BASES[basis], kind)(coef, domain, window)

    @property
    def coef(self):
        return self.inner.coef

    def __call__(self, x) -> Column:
        return val(self.basis, mapdomain(x, self.inner.domain, self.inner.window), self.coef)

    def __getattr__(self, name):
        found = getattr(self.inner, name)
        if not callable(found):
            return found

        def call(*args, **kwargs):
            out = found(*[a.inner if isinstance(a, Series) else a for a in args], **kwargs)
            return Series(self.basis, out) if isinstance(out, type(self.inner)) else out

        return call

    def _with(self, other, op):
        return Series(self.basis, op(self.inner, other.inner if isinstance(other, Series) else other))

    def __add__(self, other):
        return self._with(other, lambda a, b: a + b)

    def __sub__(self, other):
        return self._with(other, lambda a, b: a - b)

    def __mul__(self, other):
        return self._with(other, lambda a, b: a * b)

    def __pow__(self, n):
        return Series(self.basis, self.inner**n)

    def __floordiv__(self, other):
        return self._with(other, lambda a, b: a // b)

    def __mod__(self, other):
        return self._with(other, lambda a, b: a % b)

    def __neg__(self):
        return Series(self.basis, -self.inner)


# --- legacy functions: highest power first --------------------------------------


def polyval(p, x) -> Column:
    return val("poly", x, list(p)[::-1])


def polyfit(frame: DataFrame, x: str, y: str, degree: int, w: str | None = None) -> np.ndarray:
    return fit("poly", frame, x, y, degree, w)[::-1]


polyadd, polysub, polymul, polydiv, polyder, polyint, poly, roots, poly1d = np.polyadd, np.polysub, np.polymul, np.polydiv, np.polyder, np.polyint, np.poly, np.roots, np.poly1d
