"""Queries of the elementwise functions: a column for each function."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import complexes as C
from tessera.functions import strings as S
from tessera.functions import ufuncs as U
from tessera.plans.catalog import register, table

X, Y = "(o_totalprice - 250000.0) / 100000.0", "(o_orderkey % 7 - 3.0)"


def _orders(spark, sf_dir):
    """x: prices about zero; y: small signed numbers with zeros; a, b: integers."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), ((F.col("o_totalprice") - 250000.0) / 100000.0).alias("x"), (F.col("o_orderkey") % 7 - 3).cast("double").alias("y"),
        (F.col("o_orderkey") % 1000 - 300).alias("a"), (F.col("o_custkey") % 9 - 4).alias("b"),
    )


_FROM = "FROM (SELECT o_orderkey AS k, (o_totalprice - 250000.0::DOUBLE) / 100000.0::DOUBLE AS x, CAST(o_orderkey % 7 - 3 AS DOUBLE) AS y, o_orderkey % 1000 - 300 AS a, o_custkey % 9 - 4 AS b FROM orders)"


def family(name: str, columns: dict, digits: int = 9) -> None:
    """Register a query with the key and a column for each entry: name → (Column builder, SQL, rounded?)."""
    parts = []
    for out, (_, sql, rounded) in columns.items():
        parts.append(f"round({sql}, {digits}) AS {out}" if rounded else f"{sql} AS {out}")

    def run(spark, sf_dir):
        return _orders(spark, sf_dir).select("k", *[(F.round(c(), digits) if r else c()).alias(n) for n, (c, _, r) in columns.items()])

    register(name, f"SELECT k, {', '.join(parts)} {_FROM}")(run)


family("ufunc_arithmetic", {
    "f_add": ((lambda: U.add("x", "y")), "x + y", True), "f_subtract": ((lambda: U.subtract("x", "y")), "x - y", True), "f_multiply": ((lambda: U.multiply("x", "y")), "x * y", True),
    "f_divide": ((lambda: U.nan_to_num(U.divide(F.col("x"), F.col("y")), 0.0, 9e9, -9e9)), "CASE WHEN y = 0 THEN CASE WHEN x > 0 THEN 9e9 WHEN x < 0 THEN -9e9 ELSE 0 END ELSE x / y END", True),
    "f_floor_divide": ((lambda: U.floor_divide_int("a", "b")), "CASE WHEN b = 0 THEN 0 ELSE CAST(floor(a / b) AS BIGINT) END", False),
    "f_remainder": ((lambda: U.nan_to_num(U.remainder(F.col("a"), F.col("b")))), "CASE WHEN b = 0 THEN 0 ELSE CAST(a - floor(a / b) * b AS DOUBLE) END", True),
    "f_fmod": ((lambda: U.nan_to_num(U.fmod(F.col("a"), F.col("b")))), "CASE WHEN b = 0 THEN 0.0 ELSE CAST(a % b AS DOUBLE) END", True),
    "f_divmod_q": (lambda: U.nan_to_num(U.divmod_("x", F.lit(0.3))["quotient"]), "floor(x / 0.3::DOUBLE)", True),
    "f_power": ((lambda: U.power("y", F.lit(3))), "pow(y, 3)", True), "f_negative": ((lambda: U.negative("x")), "-x", True), "f_positive": ((lambda: U.positive("x")), "x", True),
    "f_absolute": ((lambda: U.absolute("x")), "abs(x)", True), "f_fabs": ((lambda: U.fabs("a")), "CAST(abs(a) AS DOUBLE)", True), "f_sign": ((lambda: U.sign("y")), "CAST(sign(y) AS DOUBLE)", True),
    "f_copysign": ((lambda: U.copysign("x", "y")), "CASE WHEN y < 0 THEN -abs(x) ELSE abs(x) END", True), "f_square": ((lambda: U.square("x")), "x * x", True),
    "f_reciprocal": ((lambda: U.nan_to_num(U.reciprocal("y"), 0.0, 1e9)), "CASE WHEN y = 0 THEN 1e9 ELSE 1 / y END", True), "f_sqrt": (lambda: U.sqrt(U.absolute("x")), "sqrt(abs(x))", True),
    "f_cbrt": ((lambda: U.cbrt("x")), "cbrt(x)", True), "f_hypot": ((lambda: U.hypot("x", "y")), "sqrt(x * x + y * y)", True), "f_heaviside": ((lambda: U.heaviside("y", F.lit(0.5))), "CASE WHEN y < 0 THEN 0.0 WHEN y = 0 THEN 0.5 ELSE 1.0 END::DOUBLE", True),
})

family("ufunc_compare", {
    "f_maximum": ((lambda: U.maximum("x", "y")), "greatest(x, y)", True), "f_minimum": ((lambda: U.minimum("x", "y")), "least(x, y)", True), "f_fmax": ((lambda: U.fmax("x", "y")), "greatest(x, y)", True), "f_fmin": ((lambda: U.fmin("x", "y")), "least(x, y)", True),
    "f_greater": ((lambda: U.greater("x", "y")), "x > y", False), "f_greater_equal": ((lambda: U.greater_equal("a", "b")), "a >= b", False), "f_less": ((lambda: U.less("x", "y")), "x < y", False), "f_less_equal": ((lambda: U.less_equal("a", "b")), "a <= b", False),
    "f_equal": ((lambda: U.equal("y", "b")), "y = b", False), "f_not_equal": ((lambda: U.not_equal("y", "b")), "y <> b", False), "f_logical_and": ((lambda: U.logical_and("y", "b")), "y <> 0 AND b <> 0", False), "f_logical_or": ((lambda: U.logical_or("y", "b")), "y <> 0 OR b <> 0", False),
    "f_logical_xor": ((lambda: U.logical_xor("y", "b")), "(y <> 0) <> (b <> 0)", False), "f_logical_not": ((lambda: U.logical_not("b")), "b = 0", False), "f_clip": ((lambda: U.clip("x", F.lit(-1.0), F.lit(1.0))), "least(greatest(x, -1.0), 1.0)", True),
    "f_isclose": ((lambda: U.isclose("y", "b")), "abs(y - b) <= 1e-8 + 1e-5 * abs(b)", False), "f_where": ((lambda: U.where(F.col("y") > 0, "x", "y")), "CASE WHEN y > 0 THEN x ELSE y END", True),
    "f_select": (lambda: U.select([F.col("b") > 2, F.col("b") < -2], [F.col("a"), -F.col("a")], F.lit(0)), "CASE WHEN b > 2 THEN a WHEN b < -2 THEN -a ELSE 0 END", False),
})

family("ufunc_bits", {
    "f_bitwise_and": ((lambda: U.bitwise_and("a", "b")), "a & b", False), "f_bitwise_or": ((lambda: U.bitwise_or("a", "b")), "a | b", False), "f_bitwise_xor": ((lambda: U.bitwise_xor("a", "b")), "xor(a, b)", False), "f_invert": ((lambda: U.invert("a")), "~a", False),
    "f_left_shift": (lambda: U.left_shift(F.abs(F.col("a")), F.abs(F.col("b"))), "abs(a) * CAST(pow(2, abs(b)) AS BIGINT)", False), "f_right_shift": (lambda: U.right_shift("a", F.abs(F.col("b"))), "a >> CAST(abs(b) AS BIGINT)", False),
    "f_bitwise_count": ((lambda: U.bitwise_count("a")), "CAST(bit_count(abs(a)) AS INTEGER)", False), "f_gcd": ((lambda: U.gcd("a", "b")), "gcd(a, b)", False), "f_lcm": ((lambda: U.lcm("a", "b")), "lcm(a, b)", False),
    "f_binary_repr": (lambda: U.binary_repr("a"), "CASE WHEN a < 0 THEN '-' || bin(-a) ELSE bin(a) END", False), "f_base_repr": (lambda: U.base_repr("a", 16), "CASE WHEN a < 0 THEN '-' ELSE '' END || upper(to_base(abs(a), 16))", False),
})

family("ufunc_exponential", {
    "f_exp": ((lambda: U.exp("x")), "exp(x)", True), "f_exp2": ((lambda: U.exp2("x")), "pow(2.0::DOUBLE, x)", True), "f_expm1": ((lambda: U.expm1("x")), "exp(x) - 1", True), "f_log": (lambda: U.log(U.absolute("x") + 1e-3), "ln(abs(x) + 1e-3)", True),
    "f_log2": (lambda: U.log2(U.absolute("x") + 1e-3), "log2(abs(x) + 1e-3)", True), "f_log10": (lambda: U.log10(U.absolute("x") + 1e-3), "log10(abs(x) + 1e-3)", True), "f_log1p": (lambda: U.log1p(U.absolute("x")), "ln(1 + abs(x))", True),
    "f_logaddexp": ((lambda: U.logaddexp("x", "y")), "ln(exp(x) + exp(y))", True), "f_logaddexp2": ((lambda: U.logaddexp2("x", "y")), "log2(pow(2.0::DOUBLE, x) + pow(2.0::DOUBLE, y))", True), "f_log_zero": (lambda: U.isneginf(U.log(F.col("y") * 0)), "true", False),
    "f_ldexp": ((lambda: U.ldexp("x", "b")), "x * pow(2.0::DOUBLE, b)", False), "f_float_power": (lambda: U.float_power(U.absolute("x"), F.lit(1.5)), "pow(abs(x), 1.5::DOUBLE)", True),
}, 8)

family("ufunc_trigonometry", {
    **{f"f_{n}": ((lambda n=n: getattr(U, n)("x")), f"{s}(x)", True) for n, s in (("sin", "sin"), ("cos", "cos"), ("arctan", "atan"), ("sinh", "sinh"), ("cosh", "cosh"), ("tanh", "tanh"), ("arcsinh", "asinh"), ("degrees", "degrees"), ("radians", "radians"))},
    "f_tan": (lambda: U.tan(F.col("x") / 4), "tan(x / 4)", True), "f_arcsin": (lambda: U.arcsin(F.col("y") / 4), "asin(y / 4)", True), "f_arccos": (lambda: U.arccos(F.col("y") / 4), "acos(y / 4)", True),
    "f_arccosh": (lambda: U.arccosh(U.absolute("x") + 1), "acosh(abs(x) + 1)", True), "f_arctanh": (lambda: U.arctanh(F.col("y") / 4), "atanh(y / 4)", True), "f_arctan2": ((lambda: U.arctan2("x", "y")), "atan2(x, y)", True),
    "f_sinc": ((lambda: U.sinc("x")), "CASE WHEN x = 0 THEN 1 ELSE sin(pi() * x) / (pi() * x) END", True),
}, 8)

family("ufunc_rounding", {
    "f_floor": ((lambda: U.floor("x")), "floor(x)", True), "f_ceil": ((lambda: U.ceil("x")), "ceil(x)", True), "f_trunc": ((lambda: U.trunc("x")), "trunc(x)", True), "f_rint": (lambda: U.rint(F.col("a") / 2), "round_even(a / 2, 0)", True),
    "f_around": (lambda: U.around("x", 2), "round_even(x * 100, 0) / 100", True), "f_modf_fraction": (lambda: U.modf("x")["fraction"], "x - trunc(x)", True), "f_modf_whole": (lambda: U.modf("x")["whole"], "trunc(x)", True),
    "f_frexp": (lambda: U.frexp("x")["mantissa"] * F.pow(F.lit(2.0), U.frexp("x")["exponent"]), "x", True), "f_nextafter": (lambda: U.nextafter("x", F.lit(9e9)) > F.col("x"), "true", False), "f_spacing": (lambda: U.spacing("x") != 0, "true", False),
})

_SPECIAL = "CASE k % 5 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE ELSE x END"


def _special():
    k = F.col("k") % 5
    return F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(float("-inf"))).otherwise(F.col("x"))


family("ufunc_classification", {
    "f_isnan": (lambda: U.isnan(_special()), "k % 5 = 0", False), "f_isinf": (lambda: U.isinf(_special()), "k % 5 IN (1, 2)", False), "f_isfinite": (lambda: U.isfinite(_special()), "k % 5 > 2", False),
    "f_isposinf": (lambda: U.isposinf(_special()), "k % 5 = 1", False), "f_isneginf": (lambda: U.isneginf(_special()), "k % 5 = 2", False), "f_signbit": (lambda: U.signbit("x"), "x < 0", False),
    "f_nan_to_num": (lambda: U.nan_to_num(_special(), 7.0, 1e6, -1e6), "CASE k % 5 WHEN 0 THEN 7.0 WHEN 1 THEN 1e6 WHEN 2 THEN -1e6 ELSE x END", True), "f_maximum_nan": (lambda: U.isnan(U.maximum(_special(), "y")), "k % 5 = 0", False),
    "f_minimum_nan": (lambda: U.isnan(U.minimum(_special(), "y")), "k % 5 = 0", False), "f_fmin_nan": (lambda: U.fmin(F.when(F.col("k") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("x")), "y"), "CASE WHEN k % 5 = 0 THEN y ELSE least(x, y) END", True),
    "f_equal_nan": (lambda: U.equal(_special(), _special()), "k % 5 <> 0", False), "f_isnat": (lambda: U.isnat(F.when(F.col("k") % 2 == 0, F.lit("2020-01-01").cast("timestamp"))), "k % 2 <> 0", False),
})

_Z = lambda: C.make("x", "y")
family("complex_functions", {
    "f_conj": (lambda: C.imag(C.conj(_Z())), "-y", True), "f_absolute": (lambda: C.absolute(_Z()), "sqrt(x * x + y * y)", True), "f_angle": (lambda: C.angle(_Z()), "atan2(y, x)", True), "f_add": (lambda: C.real(C.add(_Z(), _Z())), "2 * x", True),
    "f_multiply_re": (lambda: C.real(C.multiply(_Z(), _Z())), "x * x - y * y", True), "f_multiply_im": (lambda: C.imag(C.multiply(_Z(), _Z())), "2 * x * y", True), "f_divide": (lambda: C.real(C.divide(_Z(), C.make(F.lit(1.0), F.lit(2.0)))), "(x + 2 * y) / 5", True),
    "f_exp": (lambda: C.real(C.exp(_Z())), "exp(x) * cos(y)", True), "f_log": (lambda: C.real(C.log_(C.make("x", F.lit(1.0)))), "ln(sqrt(x * x + 1))", True), "f_sqrt": (lambda: C.real(C.power(C.sqrt(_Z()), F.lit(2))), "x", True),
    "f_iscomplex": (lambda: C.iscomplex(_Z()), "y <> 0", False), "f_isreal": (lambda: C.isreal(_Z()), "y = 0", False), "e_sqrt": (lambda: C.imag(C.emath.sqrt("x")), "CASE WHEN x < 0 THEN sqrt(-x) ELSE 0 END", True),
    "e_log": (lambda: C.imag(C.emath.log("x")), "CASE WHEN x < 0 THEN pi() ELSE 0 END", True), "e_log2": (lambda: C.imag(C.emath.log2("x")), "CASE WHEN x < 0 THEN pi() / ln(2) ELSE 0 END", True), "e_log10": (lambda: C.imag(C.emath.log10("x")), "CASE WHEN x < 0 THEN pi() / ln(10) ELSE 0 END", True),
    "e_logn": (lambda: C.imag(C.emath.logn(F.lit(3.0), "x")), "CASE WHEN x < 0 THEN pi() / ln(3) ELSE 0 END", True), "e_power": (lambda: C.imag(C.emath.power("x", F.lit(0.5))), "CASE WHEN x < 0 THEN sqrt(-x) ELSE 0 END", True),
    "e_arccos": (lambda: C.real(C.emath.arccos("y")), "CASE WHEN y >= 1 THEN 0 WHEN y <= -1 THEN pi() ELSE acos(y) END", True), "e_arcsin": (lambda: C.real(C.emath.arcsin("y")), "CASE WHEN y >= 1 THEN pi() / 2 WHEN y <= -1 THEN -pi() / 2 ELSE asin(y) END", True),
    "e_arctanh": (lambda: C.real(C.emath.arctanh(F.col("y") + 0.5)), "ln(abs((1 + (y + 0.5)) / (1 - (y + 0.5)))) / 2", True),
}, 8)


def _names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("s"), F.col("p_brand").alias("t"), (F.col("p_partkey") % 4).cast("int").alias("n"))


def strings(name: str, columns: dict) -> None:
    def run(spark, sf_dir):
        return _names(spark, sf_dir).select("p_partkey", *[c().alias(n) for n, (c, _) in columns.items()])

    sql = ", ".join(f"{q} AS {n}" for n, (_, q) in columns.items())
    register(name, f"SELECT p_partkey, {sql} FROM (SELECT p_partkey, p_name AS s, p_brand AS t, CAST(p_partkey % 4 AS INTEGER) AS n FROM part)")(run)


strings("string_tests", {
    "f_isalpha": (lambda: S.isalpha("s"), "regexp_full_match(s, '\\p{L}+')"), "f_isalnum": (lambda: S.isalnum("t"), "regexp_full_match(t, '[\\p{L}\\p{N}]+')"), "f_isdecimal": (lambda: S.isdecimal(F.col("n").cast("string")), "true"),
    "f_isdigit": (lambda: S.isdigit("s"), "regexp_full_match(s, '[0-9]+')"), "f_isnumeric": (lambda: S.isnumeric("t"), "regexp_full_match(t, '\\p{N}+')"), "f_isspace": (lambda: S.isspace(F.lit(" \t")), "true"),
    "f_islower": (lambda: S.islower("s"), "s = lower(s) AND s <> upper(s)"), "f_isupper": (lambda: S.isupper("t"), "t = upper(t) AND t <> lower(t)"), "f_istitle": (lambda: S.istitle(F.lit("Ab-Cd")), "true"),
    "f_startswith": (lambda: S.startswith("s", "p"), "starts_with(s, 'p')"), "f_endswith": (lambda: S.endswith("t", "1"), "suffix(t, '1')"), "f_equal": (lambda: S.equal("s", "t"), "s = t"), "f_not_equal": (lambda: S.not_equal("s", "t"), "s <> t"),
    "f_less": (lambda: S.less("s", "t"), "s < t"), "f_less_equal": (lambda: S.less_equal("s", "t"), "s <= t"), "f_greater": (lambda: S.greater("s", "t"), "s > t"), "f_greater_equal": (lambda: S.greater_equal("s", "t"), "s >= t"),
    "f_compare_chararrays": (lambda: S.compare_chararrays(F.concat(F.col("s"), F.lit("  ")), "s", "=="), "true"),
})
strings("string_search", {
    "f_str_len": (lambda: S.str_len("s"), "CAST(length(s) AS INTEGER)"), "f_find": (lambda: S.find("s", "a").cast("long"), "CAST(instr(s, 'a') - 1 AS BIGINT)"), "f_rfind": (lambda: S.rfind("s", "a").cast("long"), "CASE WHEN instr(s, 'a') = 0 THEN -1 ELSE CAST(length(s) - instr(reverse(s), 'a') AS BIGINT) END"),
    "f_index": (lambda: S.index(F.concat(F.col("s"), F.lit("~")), "~").cast("long"), "CAST(length(s) AS BIGINT)"), "f_rindex": (lambda: S.rindex(F.concat(F.lit("~"), F.col("s")), "~").cast("long"), "CAST(0 AS BIGINT)"),
    "f_count": (lambda: S.count("s", "a"), "CAST(length(s) - length(replace(s, 'a', '')) AS BIGINT)"),
})
strings("string_transform", {
    "f_add": (lambda: S.add("s", "t"), "s || t"), "f_multiply": (lambda: S.multiply("t", F.col("n") - 1), "repeat(t, greatest(n - 1, 0))"), "f_upper": (lambda: S.upper("s"), "upper(s)"), "f_lower": (lambda: S.lower("t"), "lower(t)"),
    "f_swapcase": (lambda: S.swapcase(F.lower("s")), "upper(s)"), "f_title": (lambda: S.title(F.lit("ab-cD e")), "'Ab-Cd E'"), "f_capitalize": (lambda: S.capitalize("t"), "upper(t[1:1]) || lower(t[2:])"),
    "f_strip": (lambda: S.strip(F.concat(F.lit(" \t"), F.col("s"), F.lit("\n "))), "s"), "f_lstrip": (lambda: S.lstrip("t", "B"), "ltrim(t, 'B')"), "f_rstrip": (lambda: S.rstrip("t", "12"), "rtrim(t, '12')"),
    "f_center": (lambda: S.center("t", 20, "*"), "repeat('*', ((20 - length(t)) // 2)::INTEGER) || t || repeat('*', (20 - length(t) - (20 - length(t)) // 2)::INTEGER)"), "f_ljust": (lambda: S.ljust("t", 20, "."), "rpad(t, 20, '.')"),
    "f_rjust": (lambda: S.rjust("t", 20, "."), "lpad(t, 20, '.')"), "f_zfill": (lambda: S.zfill(F.col("n").cast("string"), 5), "lpad(CAST(n AS VARCHAR), 5, '0')"), "f_replace": (lambda: S.replace("s", "a", "<a>"), "replace(s, 'a', '<a>')"),
    "f_replace_once": (lambda: S.replace("s", "a", "<a>", 1), "regexp_replace(s, 'a', '<a>')"), "f_partition": (lambda: S.partition("t", "#")["tail"], "CASE WHEN instr(t, '#') = 0 THEN '' ELSE substr(t, instr(t, '#') + 1) END"),
    "f_rpartition": (lambda: S.rpartition("s", "a")["tail"], "CASE WHEN instr(s, 'a') = 0 THEN s ELSE right(s, (instr(reverse(s), 'a') - 1)::INTEGER) END"), "f_decode": (lambda: S.decode(S.encode("s")), "s"),
})
