"""Elementwise functions as Column builders with array semantics.

Spark's own functions differ from IEEE array arithmetic at the edges: NULL for the
logarithm of zero, errors for a division by zero, NaN equal to itself and greater than
everything, integer results of floor, shifts modulo the width. Each builder here adds
just the guard that its function needs, as built-in expressions, so that everything
stays in generated code. NULL means masked and propagates.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

NAN, INF = float("nan"), float("inf")


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def _d(x) -> Column:
    return col(x).cast("double")


# --- arithmetic ----------------------------------------------------------------


def add(a, b):
    return col(a) + col(b)


def subtract(a, b):
    return col(a) - col(b)


def multiply(a, b):
    return col(a) * col(b)


def signbit(a):
    """The sign bit, that of -0.0 too."""
    return _d(a).cast("string").startswith("-")


def divide(a, b):
    """True division; a zero divisor gives a signed infinity, or NaN for 0/0."""
    a, b = _d(a), _d(b)
    at_zero = F.when((a == 0) | F.isnan(a), NAN).when(signbit(a) != signbit(b), -INF).otherwise(INF)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, at_zero).otherwise(F.try_divide(a, b))


true_divide = divide


def floor(a):
    a = _d(a)
    return F.when(F.isnan(a) | (F.abs(a) >= 2.0**52), a).otherwise(F.floor(a).cast("double"))


def ceil(a):
    a = _d(a)
    return F.when(F.isnan(a) | (F.abs(a) >= 2.0**52), a).otherwise(F.ceil(a).cast("double"))


def trunc(a):
    return F.when(_d(a) < 0, ceil(a)).otherwise(floor(a))


def rint(a):
    return F.rint(_d(a))


def around(a, decimals: int = 0):
    """Half to even; negative decimals round to tens."""
    a = _d(a)
    scale = 10.0 ** abs(decimals)
    scaled = F.rint(a * scale) / scale if decimals >= 0 else F.rint(a / scale) * scale
    return F.when(F.isnan(a) | (F.abs(a) == INF), a).otherwise(scaled)


round_ = around


def floor_divide(a, b):
    return floor(divide(a, b))


def floor_divide_int(a, b):
    """Of integers, towards minus infinity; a zero divisor gives 0."""
    a, b = col(a).cast("long"), col(b).cast("long")
    rest = F.try_mod(a, b)
    whole = F.try_divide((a - rest).cast("decimal(20,0)"), b.cast("decimal(20,0)")).cast("long")
    return F.when(b == 0, F.lit(0).cast("long")).when((rest != 0) & ((rest < 0) != (b < 0)), whole - 1).otherwise(whole)


def remainder(a, b):
    """Modulo with the divisor's sign."""
    a, b = _d(a), _d(b)
    rest = F.try_mod(a, b)
    return F.when(b == 0, NAN).when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)


mod = remainder


def fmod(a, b):
    return F.when(_d(b) == 0, NAN).otherwise(F.try_mod(_d(a), _d(b)))


def divmod_(a, b):
    return F.struct(floor_divide(a, b).alias("quotient"), remainder(a, b).alias("remainder"))


def power(a, b):
    return F.pow(_d(a), _d(b))


def integer_power(a, b):
    """Integers to integer powers; a negative power is an error, as there is no integer for it."""
    return F.when(col(b) < 0, F.raise_error(F.lit("Integers to negative integer powers are not allowed."))).otherwise(F.pow(_d(a), _d(b)).cast("long"))


pow_ = float_power = power


def negative(a):
    return -col(a)


def positive(a):
    return col(a)


def absolute(a):
    return F.abs(col(a))


abs_ = absolute


def fabs(a):
    return F.abs(_d(a))


def sign(a):
    return F.when(F.isnan(_d(a)), NAN).otherwise(F.signum(_d(a)))


def copysign(a, b):
    return F.when(signbit(b), -fabs(a)).otherwise(fabs(a))


def square(a):
    return col(a) * col(a)


def reciprocal(a):
    return divide(F.lit(1.0), a)


def sqrt(a):
    return F.sqrt(_d(a))


def cbrt(a):
    return F.cbrt(_d(a))


def hypot(a, b):
    return F.hypot(_d(a), _d(b))


def heaviside(a, at_zero):
    a = _d(a)
    return F.when(F.isnan(a), NAN).when(a < 0, 0.0).when(a == 0, _d(at_zero)).otherwise(1.0)


# --- extremes and comparisons --------------------------------------------------


def _any_nan(a, b):
    return F.isnan(a) | F.isnan(b)


def _both(a, b, value):
    return F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(value)


def maximum(a, b):
    a, b = _d(a), _d(b)
    return _both(a, b, F.greatest(a, b))


def minimum(a, b):
    a, b = _d(a), _d(b)
    return _both(a, b, F.when(_any_nan(a, b), NAN).otherwise(F.least(a, b)))


def fmax(a, b):
    a, b = _d(a), _d(b)
    return _both(a, b, F.greatest(F.nanvl(a, b), F.nanvl(b, a)))


def fmin(a, b):
    a, b = _d(a), _d(b)
    return _both(a, b, F.least(a, b))


def greater(a, b):
    return (_d(a) > _d(b)) & ~_any_nan(_d(a), _d(b))


def greater_equal(a, b):
    return (_d(a) >= _d(b)) & ~_any_nan(_d(a), _d(b))


def less(a, b):
    return (_d(a) < _d(b)) & ~_any_nan(_d(a), _d(b))


def less_equal(a, b):
    return (_d(a) <= _d(b)) & ~_any_nan(_d(a), _d(b))


def equal(a, b):
    return (_d(a) == _d(b)) & ~_any_nan(_d(a), _d(b))


def not_equal(a, b):
    return (_d(a) != _d(b)) | _any_nan(_d(a), _d(b))


def _truth(a):
    return col(a).cast("double") != 0


def logical_and(a, b):
    return _truth(a) & _truth(b)


def logical_or(a, b):
    return _truth(a) | _truth(b)


def logical_xor(a, b):
    return _truth(a) != _truth(b)


def logical_not(a):
    return ~_truth(a)


# --- bits ----------------------------------------------------------------------


def bitwise_and(a, b):
    return col(a).bitwiseAND(col(b))


def bitwise_or(a, b):
    return col(a).bitwiseOR(col(b))


def bitwise_xor(a, b):
    return col(a).bitwiseXOR(col(b))


def invert(a):
    return F.bitwise_not(col(a))


bitwise_not = bitwise_invert = invert


def left_shift(a, b, width: int = 64):
    """Zero once the shift reaches the width (the JVM would take it modulo the width)."""
    a, b = col(a).cast("long"), col(b).cast("int")
    return F.when((b < 0) | (b >= width), F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", a, b))


def right_shift(a, b, width: int = 64):
    a, b = col(a).cast("long"), col(b).cast("int")
    return F.when((b < 0) | (b >= width), F.when(a < 0, -1).otherwise(0).cast("long")).otherwise(F.call_function("shiftright", a, b))


bitwise_left_shift, bitwise_right_shift = left_shift, right_shift


def bitwise_count(a):
    return F.bit_count(F.abs(col(a)))


def gcd(a, b, steps: int = 48):
    """Euclid's steps as a fold over a sequence; 48 suffice below 2**33, 92 for all 64-bit integers."""
    start = F.struct(F.abs(col(a).cast("long")).alias("x"), F.abs(col(b).cast("long")).alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.try_mod(s["x"], s["y"]).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["x"]


def lcm(a, b):
    both = F.abs(col(a).cast("long") * col(b).cast("long"))
    return F.when(both == 0, F.lit(0).cast("long")).otherwise(F.floor(F.try_divide(both.cast("decimal(38,0)"), gcd(a, b).cast("decimal(38,0)"))).cast("long"))


# --- exponentials and logarithms -----------------------------------------------


def exp(a):
    return F.exp(_d(a))


def exp2(a):
    return F.pow(F.lit(2.0), _d(a))


def expm1(a):
    return F.expm1(_d(a))


def _guarded_log(f, a, zero):
    a = _d(a)
    return F.when(F.isnan(a), NAN).when(a == zero, -INF).when(a < zero, NAN).otherwise(f(a))


def log(a):
    return _guarded_log(F.ln, a, 0)


def log2(a):
    return _guarded_log(F.log2, a, 0)


def log10(a):
    return _guarded_log(F.log10, a, 0)


def log1p(a):
    return _guarded_log(F.log1p, a, -1)


def logaddexp(a, b):
    a, b = _d(a), _d(b)
    return F.when(a == b, a + math.log(2)).otherwise(F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b))))


def logaddexp2(a, b):
    a, b = _d(a), _d(b)
    return F.when(a == b, a + 1.0).otherwise(F.greatest(a, b) + F.log1p(F.pow(F.lit(2.0), -F.abs(a - b))) / math.log(2))


# --- trigonometry --------------------------------------------------------------


def _unary(f):
    def apply(a):
        return f(_d(a))

    return apply


sin, cos, tan = _unary(F.sin), _unary(F.cos), _unary(F.tan)
arcsin, arccos, arctan = _unary(F.asin), _unary(F.acos), _unary(F.atan)
sinh, cosh, tanh = _unary(F.sinh), _unary(F.cosh), _unary(F.tanh)
arcsinh, arccosh, arctanh = _unary(F.asinh), _unary(F.acosh), _unary(F.atanh)
asin, acos, atan, asinh, acosh, atanh = arcsin, arccos, arctan, arcsinh, arccosh, arctanh
degrees = rad2deg = _unary(F.degrees)
radians = deg2rad = _unary(F.radians)


def arctan2(a, b):
    """Signed zeros count: they tell the side of the cut."""
    a, b = _d(a), _d(b)
    on_axis = copysign(F.when(signbit(b), math.pi).otherwise(0.0), a)
    return F.when(F.isnan(a) | F.isnan(b), NAN).when(a == 0, on_axis).otherwise(F.atan2(a, b))


atan2 = arctan2


# --- classification and parts --------------------------------------------------


def isnan(a):
    return F.isnan(_d(a))


def isinf(a):
    return F.abs(_d(a)) == INF


def isfinite(a):
    return ~F.isnan(_d(a)) & (F.abs(_d(a)) < INF)


def isposinf(a):
    return _d(a) == INF


def isneginf(a):
    return _d(a) == -INF


def isnat(a):
    """Of timestamps: the missing ones."""
    return col(a).isNull()


def ldexp(a, b):
    return _d(a) * F.pow(F.lit(2.0), _d(b))


def frexp(a):
    """Mantissa in [0.5, 1) and exponent; zero, infinities and NaN have exponent 0."""
    a = _d(a)
    plain = F.isnan(a) | (F.abs(a) == INF) | (a == 0)
    rough = (F.floor(F.log2(F.abs(a))) + 1).cast("double")
    mantissa = a / F.pow(F.lit(2.0), rough)
    shift = F.when(F.abs(mantissa) >= 1, 1).when(F.abs(mantissa) < 0.5, -1).otherwise(0)
    return F.struct(F.when(plain, a).otherwise(mantissa / F.pow(F.lit(2.0), shift)).alias("mantissa"), F.when(plain, 0).otherwise(rough + shift).cast("int").alias("exponent"))


def modf(a):
    whole = trunc(a)
    part = F.when(F.abs(_d(a)) == INF, F.lit(0.0)).otherwise(_d(a) - whole)
    return F.struct(part.alias("fraction"), whole.alias("whole"))


@F.pandas_udf(DoubleType())
def _nextafter(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.nextafter(a.to_numpy(float), b.to_numpy(float)))


def nextafter(a, b):
    """The next double towards b; no built-in reaches the bits."""
    return _nextafter(_d(a), _d(b))


@F.pandas_udf(DoubleType())
def _spacing(a: pd.Series) -> pd.Series:
    return pd.Series(np.spacing(a.to_numpy(float)))


def spacing(a):
    return _spacing(_d(a))


# --- composed ------------------------------------------------------------------


def clip(a, low=None, high=None):
    out = _d(a)
    out = out if low is None else maximum(out, low)
    return out if high is None else minimum(out, high)


def nan_to_num(a, nan: float = 0.0, posinf: float = 1.7976931348623157e308, neginf: float = -1.7976931348623157e308):
    a = _d(a)
    return F.when(F.isnan(a), nan).when(a == INF, posinf).when(a == -INF, neginf).otherwise(a)


def isclose(a, b, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False):
    a, b = _d(a), _d(b)
    finite = isfinite(a) & isfinite(b)
    near = F.abs(a - b) <= atol + rtol * F.abs(b)
    both_nan = F.isnan(a) & F.isnan(b)
    return F.when(finite, near).otherwise((both_nan & F.lit(equal_nan)) | equal(a, b))


def sinc(x):
    y = F.lit(math.pi) * _d(x)
    return F.when(_d(x) == 0, 1.0).otherwise(F.try_divide(F.sin(y), y))


def i0(x):
    """The modified Bessel function of order 0: its power series up to 30, beyond it the asymptotic one."""
    size = F.abs(_d(x))

    def summed(terms: int, ratio):
        step = lambda s, k: F.struct((s["t"] * ratio(k)).alias("t"), (s["s"] + s["t"] * ratio(k)).alias("s"))
        return F.aggregate(F.array(*[F.lit(float(k)) for k in range(1, terms + 1)]), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), step)["s"]

    near = summed(70, lambda k: size * size / 4 / (k * k))
    far = F.exp(size) / F.sqrt(2 * math.pi * size) * summed(20, lambda k: (2 * k - 1) * (2 * k - 1) / (8 * k * size))
    return F.when(size <= 30, near).otherwise(far)


def where(condition, x, y):
    return F.when(col(condition), col(x)).otherwise(col(y))


def select(conditions, choices, default=0):
    out = col(default)
    for c, v in reversed(list(zip(conditions, choices))):
        out = F.when(col(c), col(v)).otherwise(out)
    return out


def binary_repr(a, width: int | None = None):
    """Two's complement in width digits; without a width a minus sign."""
    a = col(a).cast("long")
    if width is None:
        return F.when(a < 0, F.concat(F.lit("-"), F.bin(-a))).otherwise(F.bin(a))
    return F.when(a < 0, F.substring(F.bin(a), 64 - width + 1, width)).otherwise(F.lpad(F.bin(a), width, "0"))


def base_repr(a, base: int = 2, padding: int = 0):
    text = F.conv(F.abs(col(a)).cast("string"), 10, base)
    return F.concat(F.when(col(a) < 0, "-").otherwise(""), F.lit("0" * padding), text)
