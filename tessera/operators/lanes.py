"""Operators that need a whole lane or matrix in one place: FFT and dense linear algebra.

Lanes (or matrices over the last two axes) are groups of a cell table; groups run in
parallel, each must fit a task. numpy does the arithmetic on Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators.array import NdArray, linear, reshape, unlinear

#: Cells that a group of blocks holds, a block at least.
CELLS = 1 << 16


def blocks(a: NdArray, core: int, function, out_core: tuple[int, ...], complex_out: bool = False) -> NdArray:
    """Apply a numpy function to the block over the last core axes of each group of leading coordinates.

    Small blocks share a group, so that a group is not a call for a few numbers.
    """
    split = a.ndim - core
    lead, shape = a.shape[:split], a.shape[split:]
    size = math.prod(shape)
    is_complex = a.dtype.startswith("struct")
    value = [F.col("v.re").alias("re"), F.col("v.im").alias("im")] if is_complex else [F.col("v").alias("re")]
    at = linear(a.axes[:split], lead)
    cells = a.cells.select(F.floor(at / max(1, CELLS // max(1, size))).alias("g"), at.alias("l"), linear(a.axes[split:], shape).alias("p"), *value)

    def run(group: pa.Table) -> pa.Table:
        names, place = np.unique(group.column("l").to_numpy(), return_inverse=True)
        values = group.column("re").to_numpy()
        values = values + 1j * group.column("im").to_numpy() if is_complex else values
        block = np.zeros((len(names), size), values.dtype)
        block[place, group.column("p").to_numpy()] = values
        found = np.stack([np.asarray(function(x.reshape(shape))) for x in block]).reshape(len(names), -1)
        columns = {"l": np.repeat(names, found.shape[1]), "p": np.tile(np.arange(found.shape[1]), len(names)), "re": found.real.ravel().astype(float)}
        return pa.table(columns | ({"im": found.imag.ravel().astype(float)} if complex_out else {}))

    out = cells.groupBy("g").applyInArrow(run, "l bigint, p bigint, re double" + (", im double" if complex_out else ""))
    inner = [c.alias(f"i{split + k}") for k, c in enumerate(unlinear(F.col("p"), out_core))]
    value = F.struct("re", "im") if complex_out else F.col("re")
    return NdArray(out.select(*unlinear(F.col("l"), lead), *inner, value.alias("v")), (*lead, *out_core))


def along(a: NdArray, axis: int, function, length: int, complex_out: bool = False) -> NdArray:
    """Apply a numpy function of one lane along an axis."""
    from tessera.operators.array import moveaxis

    axis = a.axis(axis)
    return moveaxis(blocks(moveaxis(a, axis, -1), 1, function, (length,), complex_out), -1, axis)


def convolved(c: NdArray, x: NdArray) -> NdArray:
    """The circular convolution of two real vectors of equal length."""
    n = c.size
    both = c.cells.select(F.col("i0"), F.lit(0).cast("long").alias("side"), F.col("v").cast("double").alias("v")).unionByName(x.cells.select("i0", F.lit(1).cast("long").alias("side"), F.col("v").cast("double").alias("v")))
    pair = NdArray(both.select(F.col("side").alias("i0"), F.col("i0").alias("i1"), "v"), (2, n))
    return blocks(pair, 2, lambda m: np.fft.irfft(np.fft.rfft(m[0]) * np.fft.rfft(m[1]), n), (n,))


# --- FFT -----------------------------------------------------------------------


def _fft(name: str, real_out: bool, size):
    def apply(a: NdArray, n: int | None = None, axis: int = -1, norm: str | None = None) -> NdArray:
        have = a.shape[a.axis(axis)]
        f = getattr(np.fft, name)
        return along(a, axis, lambda lane: f(lane, n=n, norm=norm), size(n, have), not real_out)

    apply.__doc__ = f"numpy's {name} of every lane along an axis; n crops or pads, norm scales."
    return apply


fft = _fft("fft", False, lambda n, have: n or have)
ifft = _fft("ifft", False, lambda n, have: n or have)
rfft = _fft("rfft", False, lambda n, have: (n or have) // 2 + 1)
irfft = _fft("irfft", True, lambda n, have: n or 2 * (have - 1))
hfft = _fft("hfft", True, lambda n, have: n or 2 * (have - 1))
ihfft = _fft("ihfft", False, lambda n, have: (n or have) // 2 + 1)


def _fftn(first, rest, last_axis_first: bool):
    """N-D transforms axis by axis."""

    def apply(a: NdArray, s=None, axes=None, norm: str | None = None) -> NdArray:
        axes = list(range(a.ndim))[-len(s) :] if axes is None and s is not None else list(range(a.ndim)) if axes is None else [a.axis(k) for k in axes]
        sizes = list(s) if s is not None else [None] * len(axes)
        if last_axis_first:
            a = first(a, sizes[-1], axes[-1], norm)
            for n, k in zip(sizes[:-1], axes[:-1]):
                a = rest(a, n, k, norm)
            return a
        for n, k in zip(sizes[:-1], axes[:-1]):
            a = rest(a, n, k, norm)
        return first(a, sizes[-1], axes[-1], norm)

    return apply


fftn, ifftn = _fftn(fft, fft, True), _fftn(ifft, ifft, True)
rfftn, irfftn = _fftn(rfft, fft, True), _fftn(irfft, ifft, False)


def _two(f):
    return lambda a, s=None, axes=(-2, -1), norm=None: f(a, s, axes, norm)


fft2, ifft2, rfft2, irfft2 = _two(fftn), _two(ifftn), _two(rfftn), _two(irfftn)


def fftshift(a: NdArray, axes=None) -> NdArray:
    """Coordinate arithmetic; no lane is gathered."""
    return NdArray(a.cells.withColumns({f"i{k}": F.pmod(F.col(f"i{k}") + a.shape[k] // 2, F.lit(a.shape[k])) for k in a.axes_of(axes)}), a.shape)


def ifftshift(a: NdArray, axes=None) -> NdArray:
    return NdArray(a.cells.withColumns({f"i{k}": F.pmod(F.col(f"i{k}") - a.shape[k] // 2, F.lit(a.shape[k])) for k in a.axes_of(axes)}), a.shape)


def fftfreq(spark, n: int, d: float = 1.0) -> NdArray:
    from tessera.operators.array import arange

    if n * d == 0:
        raise ZeroDivisionError("division by zero")
    return arange(spark, n).map(lambda k: F.when(k < (n + 1) // 2, k).otherwise(k - n) / F.lit(n * d))


def rfftfreq(spark, n: int, d: float = 1.0) -> NdArray:
    from tessera.operators.array import arange

    if n * d == 0:
        raise ZeroDivisionError("division by zero")
    return arange(spark, n // 2 + 1).map(lambda k: k / F.lit(n * d))


# --- window functions ----------------------------------------------------------


def _taper(spark, m: int, f) -> NdArray:
    from tessera.operators.array import arange

    if m < 1:
        return NdArray(spark.range(0).selectExpr("id AS i0", "cast(0 AS double) AS v"), (0,))
    if m == 1:
        return arange(spark, 1).map(lambda k: F.lit(1.0))
    return arange(spark, m).map(lambda k: f((2 * k - (m - 1)).cast("double") / (m - 1)))


def bartlett(spark, m: int) -> NdArray:
    return _taper(spark, m, lambda t: 1 - F.abs(t))


def hanning(spark, m: int) -> NdArray:
    return _taper(spark, m, lambda t: 0.5 + 0.5 * F.cos(math.pi * t))


def hamming(spark, m: int) -> NdArray:
    return _taper(spark, m, lambda t: 0.54 + 0.46 * F.cos(math.pi * t))


def blackman(spark, m: int) -> NdArray:
    return _taper(spark, m, lambda t: 0.42 + 0.5 * F.cos(math.pi * t) + 0.08 * F.cos(2 * math.pi * t))


def kaiser(spark, m: int, beta: float) -> NdArray:
    from tessera.functions.ufuncs import i0

    return _taper(spark, m, lambda t: i0(beta * F.sqrt(F.greatest(1 - t * t, F.lit(0.0)))) / i0(F.lit(float(beta))))


def as_lane(a: NdArray) -> NdArray:
    return reshape(a, (1, a.size))
