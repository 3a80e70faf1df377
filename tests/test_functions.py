"""Column functions against numpy and Python, edges above all."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import complexes as C
from tessera.functions import polynomials as P
from tessera.functions import strings as S
from tessera.functions import types
from tessera.functions import ufuncs as U

SPECIAL = [float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1.0, -1.0, 2.5, -2.5, 1e300, 5e-324]


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(i, x, y) for i, (x, y) in enumerate((x, y) for x in SPECIAL for y in SPECIAL)]
    return spark.createDataFrame(rows, "k int, x double, y double").cache()


UNARY = ["negative", "fabs", "sign", "square", "reciprocal", "sqrt", "cbrt", "exp", "exp2", "expm1", "log", "log2", "log10", "log1p", "sin", "cos", "tan", "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "arcsinh", "arccosh", "arctanh", "degrees", "radians", "floor", "ceil", "trunc", "rint", "isnan", "isinf", "isfinite", "signbit", "spacing", "logical_not", "isposinf", "isneginf", "nan_to_num"]
BINARY = ["add", "subtract", "multiply", "divide", "remainder", "fmod", "power", "maximum", "minimum", "fmax", "fmin", "greater", "greater_equal", "less", "less_equal", "equal", "not_equal", "logical_and", "logical_or", "logical_xor", "copysign", "hypot", "arctan2", "heaviside", "logaddexp", "nextafter"]


@pytest.mark.filterwarnings("ignore")
def test_unary(pairs):
    got = pairs.orderBy("k").select("x", *[getattr(U, n)("x").alias(n) for n in UNARY]).toPandas()
    x = got.x.to_numpy()
    with np.errstate(all="ignore"):
        for n in UNARY:
            want = getattr(np, n)(x)
            mine = got[n].to_numpy().astype(float)
            finite = (np.abs(x) < 1e15) | ~np.isfinite(x) | ~np.isin(n, ["sin", "cos", "tan"])
            np.testing.assert_allclose(mine[finite], want.astype(float)[finite], rtol=1e-12, atol=1e-300, err_msg=n)


@pytest.mark.filterwarnings("ignore")
def test_binary(pairs):
    got = pairs.orderBy("k").select("x", "y", *[getattr(U, n)("x", "y").alias(n) for n in BINARY]).toPandas()
    x, y = got.x.to_numpy(), got.y.to_numpy()
    with np.errstate(all="ignore"):
        for n in BINARY:
            want = getattr(np, n)(x, y).astype(float)
            plain = np.isfinite(x) & np.isfinite(y) if n in ("remainder", "fmod", "logaddexp", "heaviside", "power") else np.ones(len(x), bool)
            plain &= ~((np.abs(x) > 1e200) | (np.abs(y) > 1e200)) if n in ("remainder", "fmod") else True
            np.testing.assert_allclose(got[n].to_numpy().astype(float)[plain], want[plain], rtol=1e-12, err_msg=n)


def test_integers(spark):
    rows = [(a, b) for a in (-7, -1, 0, 5, 12, 2**40) for b in (-3, -1, 0, 2, 7)]
    frame = spark.createDataFrame(rows, "a long, b long")
    got = frame.select("a", "b", U.floor_divide_int("a", "b").alias("q"), U.gcd("a", "b").alias("g"), U.lcm("a", "b").alias("l"), U.bitwise_count("a").alias("c"), U.left_shift("a", F.lit(70)).alias("s"), U.binary_repr("a").alias("r"), types.wrapped("a", 8).alias("w")).collect()
    for r in got:
        assert r.q == (0 if r.b == 0 else r.a // r.b) and r.g == np.gcd(r.a, r.b) and r.l == np.lcm(r.a, r.b)
        assert r.c == bin(abs(r.a)).count("1") and r.s == 0 and r.r == np.binary_repr(r.a) and r.w == np.int64(r.a).astype(np.int8)
    with pytest.raises(Exception, match="negative integer powers"):
        frame.select(U.integer_power("a", F.lit(-1))).collect()


def test_parts(pairs):
    got = pairs.select("x", U.frexp("x").alias("f"), U.modf("x").alias("m"), U.sinc("x").alias("s"), U.i0("y").alias("i"), "y").collect()
    for r in got:
        if np.isfinite(r.x) and r.x:
            if abs(r.x) > 1e-300:
                assert (r.f["mantissa"], r.f["exponent"]) == np.frexp(r.x)
            assert (r.m["fraction"], r.m["whole"]) == np.modf(r.x)
            if abs(r.x) < 100:
                assert r.s == pytest.approx(np.sinc(r.x), abs=1e-12)
        if abs(r.y) < 10:
            assert r.i == pytest.approx(np.i0(r.y))


def test_complex(spark):
    frame = spark.createDataFrame([(1.5, -2.0), (-1.0, 0.5), (0.0, 1.0)], "a double, b double")
    z = C.make("a", "b")
    for r in frame.select("a", "b", C.exp(z).alias("e"), C.sqrt(z).alias("s"), C.log_(z).alias("l"), C.multiply(z, z).alias("m"), C.angle(z).alias("t"), C.divide(C.make(F.lit(1.0)), z).alias("d")).collect():
        w = complex(r.a, r.b)
        for mine, theirs in ((r.e, np.exp(w)), (r.s, np.sqrt(w)), (r.l, np.log(w)), (r.m, w * w), (r.d, 1 / w)):
            assert complex(mine["re"], mine["im"]) == pytest.approx(theirs)
        assert r.t == pytest.approx(np.angle(w))
    real = spark.createDataFrame([(x,) for x in (-2.0, -0.5, 0.5, 2.0)], "x double")
    for r in real.select("x", *[getattr(C.emath, n)("x").alias(n) for n in ("sqrt", "log", "log2", "log10", "arccos", "arctanh")], C.emath.power("x", F.lit(0.5)).alias("power")).collect():
        for n in ("sqrt", "log", "log2", "log10", "arccos", "arctanh"):
            assert complex(r[n]["re"], r[n]["im"]) == pytest.approx(complex(getattr(np.emath, n)(r.x))), n
        assert complex(r["power"]["re"], r["power"]["im"]) == pytest.approx(complex(np.emath.power(r.x, 0.5)))


def test_strings(spark):
    texts = ["", "abc", "ABC", "Ab-Cd E", "ab1", "12", "²", "Ⅷ", " \t", "ÉTÉ", "straße", "-42", "+7", "aXbXc", "中文", "XX"]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select(
        "s", *[getattr(S, n)("s").alias(n) for n in ("isalpha", "isalnum", "isdecimal", "isdigit", "isnumeric", "isspace", "islower", "isupper", "istitle", "swapcase", "title", "capitalize", "strip", "upper", "lower")],
        S.zfill("s", 6).alias("zfill"), S.center("s", 7, "*").alias("center"), S.center("s", 8, "*").alias("center8"), S.find("s", "X").alias("find"), S.rfind("s", "X").alias("rfind"), S.count("s", "X").alias("count"), S.replace("s", "X", "--", 1).alias("replace1"),
        S.partition("s", "X").alias("partition"), S.rpartition("s", "X").alias("rpartition"), S.find("s", "X", 2).alias("find2"), S.endswith("s", "c", 0, -1).alias("ends"), S.ljust("s", 5, ".").alias("ljust"), S.rjust("s", 5, ".").alias("rjust"),
    ).collect()
    for r in got:
        s = r.s
        for n in ("isalpha", "isalnum", "isdecimal", "isdigit", "isnumeric", "isspace", "islower", "isupper", "istitle", "swapcase", "title", "capitalize", "strip", "upper", "lower"):
            assert r[n] == getattr(s, n)(), (n, s)
        assert (r.zfill, r.center, r.center8) == (s.zfill(6), s.center(7, "*"), s.center(8, "*"))
        assert (r.find, r.rfind, r["count"], r.replace1, r.find2, r.ends) == (s.find("X"), s.rfind("X"), s.count("X"), s.replace("X", "--", 1), s.find("X", 2), s.endswith("c", 0, -1))
        assert tuple(r.partition) == s.partition("X") and tuple(r.rpartition) == s.rpartition("X") and r.ljust == s.ljust(5, ".") and r.rjust == s.rjust(5, ".")


@pytest.mark.parametrize("basis", P.BASES)
def test_polynomials(spark, basis):
    c = [1.0, -0.5, 0.25, 2.0, -1.0]
    rows = spark.createDataFrame([(float(x),) for x in np.linspace(-0.9, 0.9, 13)], "x double")
    got = rows.select("x", P.val(basis, "x", c).alias("v"), P.vander(basis, "x", 4).alias("n"), P.weight(basis, "x").alias("w")).toPandas()
    module = P.BASES[basis]
    x = got.x.to_numpy()
    np.testing.assert_allclose(got.v, getattr(module, f"{basis}val")(x, c), rtol=1e-10)
    np.testing.assert_allclose(np.stack(got.n), getattr(module, f"{basis}vander")(x, 4), rtol=1e-10, atol=1e-12)
    fitted = P.fit(basis, rows.withColumn("y", P.val(basis, "x", c)), "x", "y", 4)
    np.testing.assert_allclose(fitted, c, rtol=1e-5)
    series = P.Series(basis, c)
    total = (series * series + series).deriv()
    np.testing.assert_allclose(rows.select(total("x").alias("v")).toPandas().v, (series.inner * series.inner + series.inner).deriv()(x), rtol=1e-9)


def test_types_and_errors(spark):
    assert types.common_type("int", "float") == "double" and types.common_type("boolean", "tinyint") == "tinyint"
    frame = spark.createDataFrame([(300.7,), (-129.9,)], "x double")
    assert [r[0] for r in frame.select(types.astype("x", "tinyint")).collect()] == [44, 127]
    with types.errstate(divide="raise"):
        with pytest.raises(Exception, match="divide by zero"):
            frame.select(types.checked(U.divide("x", F.lit(0.0)), "x")).collect()
    assert types.geterr()["divide"] == "warn"
