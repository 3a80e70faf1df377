"""String functions as Column builders: Unicode rules for text, NULL propagates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from tessera.functions.ufuncs import col


def _matches(pattern: str):
    def apply(s) -> Column:
        return col(s).rlike(f"(?U)^{pattern}+$")

    return apply


isalpha = _matches(r"\p{L}")
isalnum = _matches(r"[\p{L}\p{N}]")
isdecimal = _matches(r"\p{Nd}")
isdigit = _matches(r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]")
isnumeric = _matches(r"\p{N}")
isspace = _matches(r"[\s\x1c-\x1f\x85]")


def islower(s):
    return (col(s) == F.lower(col(s))) & (col(s) != F.upper(col(s)))


def isupper(s):
    return (col(s) == F.upper(col(s))) & (col(s) != F.lower(col(s)))


def _text(f, kind):
    """A Python rule for which Spark has no exact counterpart, Arrow batches at a time."""

    @F.pandas_udf(kind)
    def apply(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return lambda s: apply(col(s))


istitle = _text(str.istitle, BooleanType())
title = _text(str.title, StringType())
swapcase = _text(str.swapcase, StringType())


def str_len(s):
    return F.char_length(col(s))


def add(a, b):
    return F.concat(col(a), col(b))


def multiply(s, n):
    return F.call_function("repeat", col(s), F.greatest(col(n), F.lit(0)).cast("int"))


def upper(s):
    return F.upper(col(s))


def lower(s):
    return F.lower(col(s))


def capitalize(s):
    s = col(s)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substr(s, F.lit(2))))


def _strip(s, chars, left, right):
    s = col(s)
    group = r"[\s\x1c-\x1f\x85]" if chars is None else "[" + "".join("\\" + c if c in r"\]^-[&" else c for c in chars) + "]"
    if left:
        s = F.regexp_replace(s, f"(?U)^{group}+", "")
    return F.regexp_replace(s, f"(?U){group}+$", "") if right else s


def strip(s, chars: str | None = None):
    return _strip(s, chars, True, True)


def lstrip(s, chars: str | None = None):
    return _strip(s, chars, True, False)


def rstrip(s, chars: str | None = None):
    return _strip(s, chars, False, True)


def _wide(s, width):
    return F.greatest(F.lit(width), F.char_length(s))


def ljust(s, width: int, fill: str = " "):
    s = col(s)
    return F.rpad(s, _wide(s, width), F.lit(fill))


def rjust(s, width: int, fill: str = " "):
    s = col(s)
    return F.lpad(s, _wide(s, width), F.lit(fill))


def center(s, width: int, fill: str = " "):
    """Padding on both sides; an odd rest goes left where the width is odd."""
    s = col(s)
    pad = F.greatest(F.lit(width) - F.char_length(s), F.lit(0))
    left = (pad / 2).cast("int") + pad.bitwiseAND(F.lit(width)).bitwiseAND(F.lit(1))
    return F.rpad(F.lpad(s, F.char_length(s) + left, F.lit(fill)), _wide(s, width), F.lit(fill))


def zfill(s, width: int):
    s = col(s)
    signed = F.substring(s, 1, 1).isin("+", "-")
    rest = F.substr(s, F.lit(2))
    return F.when(signed, F.concat(F.substring(s, 1, 1), F.lpad(rest, F.greatest(F.lit(width - 1), F.char_length(rest)), F.lit("0")))).otherwise(rjust(s, width, "0"))


def _part(s, start, end):
    s = col(s)
    n = F.char_length(s)
    low = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    high = n if end is None else F.least(F.lit(end), n) if end >= 0 else n + end
    return low, F.substr(s, low + 1, F.greatest(high - low, F.lit(0)))


def find(s, sub: str, start: int = 0, end: int | None = None):
    low, part = _part(s, start, end)
    at = F.instr(part, sub)
    if sub == "":
        return F.when(low <= F.char_length(col(s)), low).otherwise(-1)
    return F.when(at == 0, -1).otherwise(at - 1 + low)


def rfind(s, sub: str, start: int = 0, end: int | None = None):
    low, part = _part(s, start, end)
    at = F.instr(F.reverse(part), sub[::-1])
    if sub == "":
        return low + F.char_length(part)
    return F.when(at == 0, -1).otherwise(low + F.char_length(part) - at + 1 - len(sub))


def index(s, sub: str, start: int = 0, end: int | None = None):
    at = find(s, sub, start, end)
    return F.when(at < 0, F.raise_error(F.lit("substring not found"))).otherwise(at)


def rindex(s, sub: str, start: int = 0, end: int | None = None):
    at = rfind(s, sub, start, end)
    return F.when(at < 0, F.raise_error(F.lit("substring not found"))).otherwise(at)


def count(s, sub: str, start: int = 0, end: int | None = None):
    _, part = _part(s, start, end)
    n = F.char_length(part)
    return n + 1 if sub == "" else ((n - F.char_length(F.replace(part, F.lit(sub), F.lit("")))) / len(sub)).cast("long")


def startswith(s, prefix: str, start: int = 0, end: int | None = None):
    return _part(s, start, end)[1].startswith(prefix)


def endswith(s, suffix: str, start: int = 0, end: int | None = None):
    return _part(s, start, end)[1].endswith(suffix)


def replace(s, old: str, new: str, count: int = -1):
    """All occurrences, or the first count ones: the string is split count times and joined."""
    s = col(s)
    if count < 0:
        return F.replace(s, F.lit(old), F.lit(new))
    pieces = F.split(s, "\\Q" + old + "\\E", count + 1)
    return F.array_join(pieces, new)


def partition(s, sep: str):
    s = col(s)
    at = F.instr(s, sep)
    miss = F.struct(s.alias("head"), F.lit("").alias("sep"), F.lit("").alias("tail"))
    return F.when(at == 0, miss).otherwise(F.struct(F.substr(s, F.lit(1), at - 1).alias("head"), F.lit(sep).alias("sep"), F.substr(s, at + len(sep)).alias("tail")))


def rpartition(s, sep: str):
    s = col(s)
    at = rfind(s, sep)
    miss = F.struct(F.lit("").alias("head"), F.lit("").alias("sep"), s.alias("tail"))
    return F.when(at < 0, miss).otherwise(F.struct(F.substr(s, F.lit(1), at).alias("head"), F.lit(sep).alias("sep"), F.substr(s, at + 1 + len(sep)).alias("tail")))


def encode(s, charset: str = "UTF-8"):
    return F.encode(col(s), charset)


def decode(b, charset: str = "UTF-8"):
    return F.decode(col(b), charset)


def compare_chararrays(a, b, op: str, rstrip_first: bool = True):
    """Comparison by an operator's name, trailing white space dropped first if asked."""
    a, b = (rstrip(a), rstrip(b)) if rstrip_first else (col(a), col(b))
    return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def equal(a, b):
    return col(a) == col(b)


def not_equal(a, b):
    return col(a) != col(b)


def less(a, b):
    return col(a) < col(b)


def less_equal(a, b):
    return col(a) <= col(b)


def greater(a, b):
    return col(a) > col(b)


def greater_equal(a, b):
    return col(a) >= col(b)
