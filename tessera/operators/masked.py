"""Masked arrays: NULL is the mask, so Spark's own NULL rules are the masked rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import ufuncs as U
from tessera.operators import array as _array
from tessera.operators import reduce as R
from tessera.operators.array import NdArray

#: The default fill values by kind.
FILL = {"boolean": True, "int": 999999, "bigint": 999999, "smallint": 999999, "tinyint": 63, "double": 1e20, "float": 1e20, "string": "N/A"}


class MaskError(Exception):
    pass


def default_fill_value(a: NdArray):
    return FILL[a.dtype]


def getmask(a: NdArray) -> NdArray:
    return a.map(lambda v: v.isNull())


getmaskarray = getmask


def filled(a: NdArray, fill_value=None) -> NdArray:
    return a.map(lambda v: F.coalesce(v, F.lit(FILL[a.dtype] if fill_value is None else fill_value)))


def masked_where(condition: NdArray, a: NdArray) -> NdArray:
    return a.zip(condition, lambda v, c: F.when(~F.coalesce(c, F.lit(False)), v))


def _comparator(test):
    return lambda a, x: a.map(lambda v: F.when(~test(v, F.lit(x)), v))


masked_equal, masked_not_equal = _comparator(U.equal), _comparator(U.not_equal)
masked_greater, masked_greater_equal = _comparator(U.greater), _comparator(U.greater_equal)
masked_less, masked_less_equal = _comparator(U.less), _comparator(U.less_equal)
masked_object = masked_equal


def masked_inside(a: NdArray, low, high) -> NdArray:
    low, high = min(low, high), max(low, high)
    return a.map(lambda v: F.when(~v.between(low, high), v))


def masked_outside(a: NdArray, low, high) -> NdArray:
    low, high = min(low, high), max(low, high)
    return a.map(lambda v: F.when(v.between(low, high), v))


def masked_invalid(a: NdArray) -> NdArray:
    return a.map(lambda v: F.when(U.isfinite(v), v))


fix_invalid = masked_invalid


def masked_values(a: NdArray, value: float, rtol: float = 1e-5, atol: float = 1e-8) -> NdArray:
    return a.map(lambda v: F.when(~U.isclose(v, F.lit(value), rtol, atol), v))


def masked_all(spark, shape, kind: str = "double") -> NdArray:
    from tessera.operators.array import grid

    return grid(spark, shape, F.lit(None).cast(kind))


def masked_all_like(a: NdArray) -> NdArray:
    return a.map(lambda v: F.lit(None).cast(a.dtype))


def is_masked(a: NdArray) -> bool:
    return bool(a.cells.agg(F.coalesce(F.bool_or(F.col("v").isNull()), F.lit(False))).first()[0])


def _guarded(f, outside):
    return lambda a: a.map(lambda v: F.when(~outside(v), f(v)))


sqrt = _guarded(U.sqrt, lambda v: v < 0)
log, log2, log10 = (_guarded(f, lambda v: v <= 0) for f in (U.log, U.log2, U.log10))
arcsin, arccos = (_guarded(f, lambda v: F.abs(v) > 1) for f in (U.arcsin, U.arccos))
arccosh, arctanh = _guarded(U.arccosh, lambda v: v < 1), _guarded(U.arctanh, lambda v: F.abs(v) >= 1)
#: Fixed value: the least normal double, below which a divisor counts as zero.
TINY = 2.2250738585072014e-308


def _divided(f):
    return lambda a, b: a.zip(b, lambda x, y: F.when(F.abs(x) * TINY < F.abs(y), f(x, y)))


divide = true_divide = _divided(U.divide)
floor_divide, remainder, fmod = _divided(U.floor_divide), _divided(U.remainder), _divided(U.fmod)
mod = remainder


def unary(name: str):
    """abs, exp, sin, negative, … by name: NULL propagates."""
    return lambda a: a.map(getattr(U, name))


def binary(name: str):
    return lambda a, b: a.zip(b, getattr(U, name))


def count(a: NdArray, axis=None, keepdims=False):
    return R._reduced(a, axis, F.count, keepdims)


def count_masked(a: NdArray, axis=None):
    return R._reduced(a, axis, lambda v: F.count_if(v.isNull()))


def sum_(a: NdArray, axis=None, keepdims=False):
    """NULL where all are masked."""
    return R._reduced(a, axis, F.sum, keepdims)


def mean(a: NdArray, axis=None, keepdims=False):
    return R._reduced(a, axis, F.avg, keepdims)


def min_(a: NdArray, axis=None, keepdims=False):
    return R._reduced(a, axis, F.min, keepdims)


def max_(a: NdArray, axis=None, keepdims=False):
    return R._reduced(a, axis, F.max, keepdims)


def ptp(a: NdArray, axis=None, keepdims=False):
    return R._reduced(a, axis, lambda v: F.max(v) - F.min(v), keepdims)


def any_(a: NdArray, axis=None, keepdims=False):
    return R._reduced(a, axis, lambda v: F.bool_or(v.cast("double") != 0), keepdims)


def all_(a: NdArray, axis=None, keepdims=False):
    return R._reduced(a, axis, lambda v: F.bool_and(v.cast("double") != 0), keepdims)


alltrue, sometrue = all_, any_
argmax, argmin = R.nanargmax, R.nanargmin


def cumsum(a: NdArray, axis=None):
    """Masked cells count as 0 and stay masked."""
    return R.cumsum(a.map(lambda v: F.coalesce(v, F.lit(0).cast(a.dtype))), axis).zip(a, lambda s, v: F.when(v.isNotNull(), s))


def cumprod(a: NdArray, axis=None):
    return R.cumprod(a.map(lambda v: F.coalesce(v, F.lit(1).cast(a.dtype))), axis).zip(a, lambda s, v: F.when(v.isNotNull(), s))


def compressed(a: NdArray) -> DataFrame:
    """The cells that aren't masked."""
    return a.cells.where("v IS NOT NULL")


def nonzero(a: NdArray) -> DataFrame:
    return a.cells.where(F.col("v").isNotNull() & (F.col("v") != 0)).select(*a.axes)


def allequal(a: NdArray, b: NdArray, fill_value: bool = True) -> bool:
    same = a.zip(b, lambda x, y: F.coalesce(x == y, F.lit(fill_value)))
    return bool(same.cells.agg(F.coalesce(F.bool_and("v"), F.lit(True))).first()[0])


def mask_or(a: NdArray, b: NdArray) -> NdArray:
    return a.zip(b, lambda x, y: x | y)


def forward_filled(a: NdArray) -> NdArray:
    """Masked cells take the last value before them on their lane."""
    name = a.axes[-1]
    w = Window.partitionBy(*a.axes[:-1]).orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
    return NdArray(a.cells.withColumn("v", F.last("v", ignorenulls=True).over(w)), a.shape)


# --- shape functions: NULL travels with its cell, so those of arrays serve -------



def _like(make):
    return lambda a: make(a).zip(a, lambda x, v: F.when(v.isNotNull(), x))


zeros, ones, empty, identity = _array.zeros, _array.ones, _array.empty, _array.identity
zeros_like, ones_like, empty_like = _like(_array.zeros_like), _like(_array.ones_like), _like(_array.empty_like)
append, concatenate, vstack, row_stack, hstack, dstack, column_stack = _array.append, _array.concatenate, _array.vstack, _array.row_stack, _array.hstack, _array.dstack, _array.column_stack
reshape, ravel, transpose, swapaxes, squeeze, expand_dims, resize = _array.reshape, _array.ravel, _array.transpose, _array.swapaxes, _array.squeeze, _array.expand_dims, _array.resize
repeat, take, compress, diagflat = _array.repeat, _array.take, _array.compress, _array.diagflat
atleast_1d, atleast_2d, atleast_3d = _array.atleast_1d, _array.atleast_2d, _array.atleast_3d


def copy(a: NdArray) -> NdArray:
    """Relations don't change: the array itself."""
    return a


getdata = copy


def size(a: NdArray) -> int:
    return a.size


def ndim(a: NdArray) -> int:
    return a.ndim


def shape(a: NdArray) -> tuple[int, ...]:
    return a.shape


def is_mask(m) -> bool:
    return isinstance(m, NdArray) and m.dtype == "boolean"


def isMaskedArray(x) -> bool:
    return isinstance(x, NdArray)


isMA = isarray = isMaskedArray


def make_mask(m: NdArray) -> NdArray:
    return m.map(lambda v: F.coalesce(v.cast("boolean"), F.lit(False)))


def make_mask_none(spark, dims) -> NdArray:
    return _array.full(spark, dims, False)


#: The largest and least values by kind, the identities of min and max.
_ENDS = {"boolean": (True, False), "tinyint": (127, -128), "smallint": (32767, -32768), "int": (2**31 - 1, -(2**31)), "bigint": (2**63 - 1, -(2**63)), "float": (float("inf"), float("-inf")), "double": (float("inf"), float("-inf"))}


def minimum_fill_value(a: NdArray):
    return _ENDS[a.dtype][0]


def maximum_fill_value(a: NdArray):
    return _ENDS[a.dtype][1]


def common_fill_value(a: NdArray, b: NdArray):
    return FILL[a.dtype] if FILL[a.dtype] == FILL[b.dtype] else None
