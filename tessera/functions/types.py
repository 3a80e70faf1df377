"""Types: promotion, casting and their Spark counterparts, decided on the driver before an expression is built."""

from __future__ import annotations

import contextlib

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.ufuncs import _d, col

promote_types, result_type, can_cast, min_scalar_type, iinfo, finfo, isdtype = np.promote_types, np.result_type, np.can_cast, np.min_scalar_type, np.iinfo, np.finfo, np.isdtype
typename, mintypecode = np.typename, np.mintypecode


def numpy_dtype(kind: str) -> np.dtype:
    """The array type of a Spark type."""
    if kind.startswith("decimal"):
        return np.dtype("uint64")
    return np.dtype({"boolean": "?", "tinyint": "i1", "smallint": "i2", "int": "i4", "bigint": "i8", "float": "f4", "double": "f8", "string": "U", "binary": "S", "struct<re:double,im:double>": "c16"}[kind])


def common_type(a: str, b: str) -> str:
    """The Spark type that two Spark types are promoted to."""
    from tessera.sources.npy import spark_type

    return spark_type(np.promote_types(numpy_dtype(a), numpy_dtype(b)))


def wrapped(value, bits: int):
    """An integer column cast to fewer bits, wrapping around as array casts do, without an overflow error."""
    low, size = 1 << (bits - 1), 1 << bits
    return (F.pmod(col(value).cast("decimal(38,0)") + low, F.lit(size).cast("decimal(38,0)")) - low).cast({8: "tinyint", 16: "smallint", 32: "int", 64: "bigint"}[bits])


def astype(value, kind: str):
    """Floats to integers truncate; narrower integers wrap around."""
    bits = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}.get(kind)
    return wrapped(F.when(_d(value) < 0, F.ceil(_d(value))).otherwise(F.floor(_d(value))), bits) if bits else col(value).cast(kind)


# --- floating-point errors: modes of the engine ---------------------------------

_MODES = {"divide": "warn", "over": "warn", "under": "ignore", "invalid": "warn"}
_CALL = [None]


def geterr() -> dict[str, str]:
    return dict(_MODES)


def seterr(all: str | None = None, **modes: str) -> dict[str, str]:
    old = dict(_MODES)
    for k in _MODES:
        if (mode := modes.get(k, all)) is not None:
            if mode not in ("ignore", "warn", "raise", "call", "print", "log"):
                raise ValueError(f"invalid mode {mode}")
            _MODES[k] = mode
    return old


def seterrcall(f):
    old, _CALL[0] = _CALL[0], f
    return old


def geterrcall():
    return _CALL[0]


@contextlib.contextmanager
def errstate(**modes):
    old = seterr(**modes)
    try:
        yield
    finally:
        _MODES.update(old)


def checked(result, *operands):
    """A result under the current modes: with "raise" an invalid result or a division by zero of finite operands is an error."""
    result = _d(result)
    finite = F.lit(True)
    for x in operands:
        finite = finite & ~F.isnan(_d(x)) & (F.abs(_d(x)) < float("inf"))
    out = result
    if _MODES["invalid"] == "raise":
        out = F.when(finite & F.isnan(result), F.raise_error(F.lit("invalid value encountered")).cast("double")).otherwise(out)
    if _MODES["divide"] == "raise":
        out = F.when(finite & (F.abs(result) == float("inf")), F.raise_error(F.lit("divide by zero encountered")).cast("double")).otherwise(out)
    return out
