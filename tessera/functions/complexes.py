"""Complex numbers as structs of re and im, and the functions that leave the real line."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.ufuncs import NAN, _d, col, log


def make(re, im=0.0) -> Column:
    return F.struct(_d(re).alias("re"), _d(im).alias("im"))


def real(z) -> Column:
    return col(z)["re"]


def imag(z) -> Column:
    return col(z)["im"]


def conj(z):
    return make(real(z), -imag(z))


conjugate = conj


def add(a, b):
    return make(real(a) + real(b), imag(a) + imag(b))


def subtract(a, b):
    return make(real(a) - real(b), imag(a) - imag(b))


def multiply(a, b):
    return make(real(a) * real(b) - imag(a) * imag(b), real(a) * imag(b) + imag(a) * real(b))


def divide(a, b):
    size = real(b) * real(b) + imag(b) * imag(b)
    top = multiply(a, conj(b))
    part = lambda x: F.when(size == 0, NAN).otherwise(F.try_divide(x, size))
    return make(part(top["re"]), part(top["im"]))


def absolute(z):
    return F.hypot(real(z), imag(z))


def angle(z, deg: bool = False):
    out = F.atan2(imag(z), real(z))
    return F.degrees(out) if deg else out


def exp(z):
    size = F.exp(real(z))
    return make(size * F.cos(imag(z)), size * F.sin(imag(z)))


def log_(z):
    return make(log(absolute(z)), angle(z))


def sqrt(z):
    size = absolute(z)
    re = F.sqrt(F.greatest((size + real(z)) / 2, F.lit(0.0)))
    im = F.sqrt(F.greatest((size - real(z)) / 2, F.lit(0.0)))
    return make(re, F.when(imag(z) < 0, -im).otherwise(im))


def power(z, w):
    """Real powers in polar form."""
    size, turn = F.pow(absolute(z), _d(w)), angle(z) * _d(w)
    return make(size * F.cos(turn), size * F.sin(turn))


def iscomplex(z):
    return imag(z) != 0


def isreal(z):
    return imag(z) == 0


def real_if_close(z, tol: float = 100):
    """Of a column: the condition, an aggregate, under which the imaginary parts may be dropped."""
    return F.bool_and(F.abs(imag(z)) < tol * 2.220446049250313e-16)


# --- functions that turn complex outside their real domain ---------------------


class emath:
    """Each takes a real column and gives a complex struct."""

    @staticmethod
    def sqrt(x):
        x = _d(x)
        root = F.sqrt(F.abs(x))
        return make(F.when(x < 0, 0.0).otherwise(root), F.when(x < 0, root).otherwise(0.0))

    @staticmethod
    def log(x):
        x = _d(x)
        return make(log(F.abs(x)), F.when(x < 0, math.pi).otherwise(0.0))

    @staticmethod
    def logn(n, x):
        z, base = emath.log(x), log(_d(n))
        return make(F.try_divide(z["re"], base), F.try_divide(z["im"], base))

    @staticmethod
    def log2(x):
        return emath.logn(F.lit(2.0), x)

    @staticmethod
    def log10(x):
        return emath.logn(F.lit(10.0), x)

    @staticmethod
    def power(x, p):
        x, p = _d(x), _d(p)
        size, turn = F.pow(F.abs(x), p), math.pi * p
        real_case = (x >= 0) | (p == F.rint(p))
        return make(F.when(real_case, F.pow(x, p)).otherwise(size * F.cos(turn)), F.when(real_case, 0.0).otherwise(size * F.sin(turn)))

    @staticmethod
    def arccos(x):
        x = _d(x)
        beyond = F.acosh(F.greatest(F.abs(x), F.lit(1.0)))
        return make(F.when(x > 1, 0.0).when(x < -1, math.pi).otherwise(F.acos(F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)))), F.when(F.abs(x) > 1, -beyond).otherwise(0.0))

    @staticmethod
    def arcsin(x):
        x = _d(x)
        z = emath.arccos(x)
        return make(math.pi / 2 - z["re"], -z["im"])

    @staticmethod
    def arctanh(x):
        x = _d(x)
        inside = F.abs(x) < 1
        ratio = F.abs(F.try_divide(1 + x, 1 - x))
        return make(F.when(inside, F.atanh(x)).otherwise(log(ratio) / 2), F.when(inside, 0.0).when(x > 1, math.pi / 2).otherwise(math.pi / 2))
