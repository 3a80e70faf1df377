"""Set operations and comparisons of whole arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import ufuncs as U
from tessera.operators.array import NdArray, broadcast_arrays, broadcast_shapes, dense_rank_positions


def _distinct(a: NdArray) -> DataFrame:
    return a.cells.select((F.when(F.col("v") == 0, F.lit(0.0)).otherwise(F.col("v")) if a.dtype in ("double", "float") else F.col("v")).alias("v"))


def _ordered(frame: DataFrame) -> DataFrame:
    return dense_rank_positions(frame, [F.col("v")]).withColumnRenamed("pos", "i0")


def unique_all(a: NdArray) -> DataFrame:
    """Distinct values in order: i0, v, index (first place), count. Both zeros are one value, and so are all NaN."""
    normal = a.cells.select(a.lin().alias("_p"), (F.when(F.col("v") == 0, F.lit(0.0)).otherwise(F.col("v")) if a.dtype in ("double", "float") else F.col("v")).alias("v"))
    return _ordered(normal.groupBy("v").agg(F.min("_p").alias("index"), F.count(F.lit(1)).alias("count")))


def unique(a: NdArray) -> DataFrame:
    return _ordered(_distinct(a).distinct())


def unique_values(a: NdArray) -> DataFrame:
    """Distinct values; every NaN is a value of its own."""
    apart = _distinct(a)
    return apart.where(~F.isnan(F.col("v").cast("double"))).distinct().unionByName(apart.where(F.isnan(F.col("v").cast("double"))))


def unique_counts(a: NdArray) -> DataFrame:
    return unique_all(a).select("i0", "v", "count")


def unique_inverse(a: NdArray) -> NdArray:
    """For each cell the place of its value among the distinct ones."""
    normal = F.when(F.col("v") == 0, F.lit(0.0)).otherwise(F.col("v")) if a.dtype in ("double", "float") else F.col("v")
    places = unique(a).select(F.col("v").alias("_u"), F.col("i0").alias("_n"))
    return NdArray(a.cells.withColumn("_u", normal).join(places, "_u").select(*a.axes, F.col("_n").alias("v")), a.shape)


def intersect1d(a: NdArray, b: NdArray) -> DataFrame:
    return _ordered(_distinct(a).intersect(_distinct(b)))


def union1d(a: NdArray, b: NdArray) -> DataFrame:
    return _ordered(_distinct(a).union(_distinct(b)).distinct())


def setdiff1d(a: NdArray, b: NdArray) -> DataFrame:
    return _ordered(_distinct(a).subtract(_distinct(b)))


def setxor1d(a: NdArray, b: NdArray) -> DataFrame:
    x, y = _distinct(a).distinct().withColumn("_s", F.lit(1)), _distinct(b).distinct().withColumn("_s", F.lit(2))
    return _ordered(x.union(y).groupBy("v").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("v"))


def isin(a: NdArray, test: NdArray, invert: bool = False) -> NdArray:
    members = _distinct(test).distinct().where(~F.isnan(F.col("v").cast("double"))).select(F.col("v").alias("_m"), F.lit(True).alias("_in"))
    found = a.cells.join(members, F.col("v") == F.col("_m"), "left").select(*a.axes, (F.coalesce("_in", F.lit(False)) != F.lit(invert)).alias("v"))
    return NdArray(found, a.shape)


def trim_zeros(a: NdArray, trim: str = "fb") -> NdArray:
    low, high = a.cells.where("v != 0").agg(F.min("i0"), F.max("i0")).first()
    if low is None:
        return NdArray(a.cells.where("false"), (0,))
    low = low if "f" in trim.lower() else 0
    high = high if "b" in trim.lower() else a.size - 1
    return NdArray(a.cells.where(F.col("i0").between(low, high)).withColumn("i0", F.col("i0") - low), (high - low + 1,))


def allclose(a: NdArray, b: NdArray, rtol=1e-5, atol=1e-8, equal_nan=False) -> bool:
    close = a.zip(b, lambda x, y: U.isclose(x, y, rtol, atol, equal_nan))
    return bool(close.cells.agg(F.coalesce(F.bool_and("v"), F.lit(True))).first()[0])


def array_equal(a: NdArray, b: NdArray, equal_nan: bool = False) -> bool:
    if a.shape != b.shape:
        return False
    same = (lambda x, y: x == y) if equal_nan else U.equal
    return bool(a.zip(b, same).cells.agg(F.coalesce(F.bool_and("v"), F.lit(True))).first()[0])


def array_equiv(a: NdArray, b: NdArray) -> bool:
    try:
        broadcast_shapes(a.shape, b.shape)
    except ValueError:
        return False
    return array_equal(*broadcast_arrays(a, b))


def asarray_chkfinite(a: NdArray) -> NdArray:
    return a.map(lambda v: F.when(U.isfinite(v), v).otherwise(F.raise_error(F.lit("array must not contain infs or NaNs")).cast(a.dtype)))


def ranks(a: NdArray) -> NdArray:
    """Dense ranks from 0, the inverse of unique for small lanes."""
    return NdArray(a.cells.withColumn("v", F.dense_rank().over(Window.partitionBy(*a.axes[:-1]).orderBy("v")) - 1), a.shape)
