"""Reductions, scans, order statistics and histograms over axes of a cell table.

A reduction groups by the axes that stay; Spark combines partial results before the
shuffle. The guards give array semantics: NaN propagates, empty sums are 0, an empty
minimum is an error, ties go to the first place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.array import NdArray, dense_rank_positions, range_cuts, range_of, ravel, reshape

NAN = float("nan")


def _reduced(a: NdArray, axis, make, keepdims: bool = False, empty=None) -> NdArray:
    """make: a function of the value column giving an aggregate. empty: the result of no cells."""
    gone = a.axes_of(axis)
    kept = [k for k in range(a.ndim) if k not in gone]
    out = a.cells.groupBy(*[f"i{k}" for k in kept]).agg(make(F.col("v")).alias("v")) if kept else a.cells.agg(make(F.col("v")).alias("v"))
    if empty is not None:
        out = out.withColumn("v", F.coalesce("v", F.lit(empty)))
    shape = tuple(a.shape[k] for k in kept)
    out = out.select(*[F.col(f"i{k}").alias(f"i{n}") for n, k in enumerate(kept)], "v")
    found = NdArray(out, shape)
    return reshape(found, [1 if k in gone else d for k, d in enumerate(a.shape)]) if keepdims else found



def _nan_if_any(v: Column, value: Column) -> Column:
    v = v.cast("double")
    return F.when(F.bool_or(F.isnan(v)), NAN).otherwise(value.cast("double"))


def _masked(v: Column, where: Column | None) -> Column:
    return v if where is None else F.when(where, v)


def sum_(a: NdArray, axis=None, keepdims=False, initial=0, where: Column | None = None):
    cast = (lambda v: v.cast("long")) if a.dtype in ("boolean", "tinyint", "smallint", "int") else (lambda v: v)
    return _reduced(a, axis, lambda v: F.coalesce(F.sum(cast(_masked(v, where))), F.lit(0)) + initial, keepdims)


def prod(a: NdArray, axis=None, keepdims=False, initial=1, where: Column | None = None):
    return _reduced(a, axis, lambda v: F.coalesce(F.product(_masked(v, where).cast("double")), F.lit(1.0)) * initial, keepdims)


def all_(a: NdArray, axis=None, keepdims=False):
    return _reduced(a, axis, lambda v: F.bool_and(v.cast("double") != 0), keepdims, True)


def any_(a: NdArray, axis=None, keepdims=False):
    return _reduced(a, axis, lambda v: F.bool_or(v.cast("double") != 0), keepdims, False)


def min_(a: NdArray, axis=None, keepdims=False, initial=None):
    if a.size == 0 and initial is None:
        raise ValueError("zero-size array to reduction operation minimum which has no identity")
    low = lambda v: F.min(v) if initial is None else F.least(F.coalesce(F.min(v), F.lit(initial)), F.lit(initial))
    return _reduced(a, axis, (lambda v: _nan_if_any(v, low(v))) if a.dtype in ("double", "float") else low, keepdims)


def max_(a: NdArray, axis=None, keepdims=False, initial=None):
    if a.size == 0 and initial is None:
        raise ValueError("zero-size array to reduction operation maximum which has no identity")
    return _reduced(a, axis, lambda v: F.max(v) if initial is None else F.greatest(F.coalesce(F.max(v), F.lit(initial)), F.lit(initial)), keepdims)


amin, amax = min_, max_


def _place(a: NdArray, axis) -> Column:
    return a.lin() if axis is None else F.col(f"i{a.axis(axis)}")


def argmin(a: NdArray, axis=None, keepdims=False):
    """The first place of the least value; the first NaN wins."""
    where = _place(a, axis)
    return _reduced(a, axis, lambda v: F.min(F.struct(~F.isnan(v.cast("double")), v, where.alias("p")))["p"], keepdims)


def argmax(a: NdArray, axis=None, keepdims=False):
    where = _place(a, axis)
    return _reduced(a, axis, lambda v: -F.max(F.struct(v, (-where).alias("p")))["p"], keepdims)


def _without_nan(a: NdArray) -> NdArray:
    return a.map(lambda v: F.when(~F.isnan(v.cast("double")), v))


def nanargmin(a: NdArray, axis=None, keepdims=False):
    where = _place(a, axis)
    found = lambda v: F.min(F.when(v.isNotNull(), F.struct(v, where.alias("p"))))["p"]
    return _reduced(_without_nan(a), axis, lambda v: F.coalesce(found(v), F.raise_error(F.lit("All-NaN slice encountered")).cast("long")), keepdims)


def nanargmax(a: NdArray, axis=None, keepdims=False):
    where = _place(a, axis)
    found = lambda v: -F.max(F.when(v.isNotNull(), F.struct(v, (-where).alias("p"))))["p"]
    return _reduced(_without_nan(a), axis, lambda v: F.coalesce(found(v), F.raise_error(F.lit("All-NaN slice encountered")).cast("long")), keepdims)


def mean(a: NdArray, axis=None, keepdims=False, where: Column | None = None):
    return _reduced(a, axis, lambda v: F.avg(_masked(v, where).cast("double")), keepdims, NAN)


def average(a: NdArray, weights: NdArray, axis=None):
    """The weighted mean; weights that sum to zero are an error."""
    both = a.zip(weights, lambda v, w: F.struct(v.cast("double").alias("v"), w.cast("double").alias("w")))
    total = lambda v: F.sum(v["w"])
    return _reduced(both, axis, lambda v: F.when(total(v) == 0, F.raise_error(F.lit("Weights sum to zero, can't be normalized")).cast("double")).otherwise(F.try_divide(F.sum(v["v"] * v["w"]), total(v))))


def ptp(a: NdArray, axis=None, keepdims=False):
    return _reduced(a, axis, lambda v: _nan_if_any(v, F.max(v) - F.min(v)), keepdims)


def count_nonzero(a: NdArray, axis=None, keepdims=False):
    return _reduced(a, axis, lambda v: F.count_if(v.cast("double") != 0), keepdims)


def var(a: NdArray, axis=None, ddof: float = 0, keepdims=False):
    """ddof 0 and 1 are built in; others rescale."""
    n = lambda v: F.count(v)
    return _reduced(a, axis, lambda v: F.when(n(v) - ddof <= 0, NAN).otherwise(F.var_pop(v.cast("double")) * F.try_divide(n(v).cast("double"), (n(v) - ddof).cast("double"))), keepdims, NAN)


def std(a: NdArray, axis=None, ddof: float = 0, keepdims=False):
    return var(a, axis, ddof, keepdims).map(F.sqrt)


def nansum(a: NdArray, axis=None, keepdims=False):
    return _reduced(_without_nan(a), axis, F.sum, keepdims, 0.0)


def nanprod(a: NdArray, axis=None, keepdims=False):
    return _reduced(_without_nan(a), axis, F.product, keepdims, 1.0)


def nanmin(a: NdArray, axis=None, keepdims=False):
    return _reduced(_without_nan(a), axis, F.min, keepdims, NAN)


def nanmax(a: NdArray, axis=None, keepdims=False):
    return _reduced(_without_nan(a), axis, F.max, keepdims, NAN)


def nanmean(a: NdArray, axis=None, keepdims=False):
    return _reduced(_without_nan(a), axis, F.avg, keepdims, NAN)


def nanvar(a: NdArray, axis=None, ddof: float = 0, keepdims=False):
    return var(_without_nan(a), axis, ddof, keepdims)


def nanstd(a: NdArray, axis=None, ddof: float = 0, keepdims=False):
    return nanvar(a, axis, ddof, keepdims).map(F.sqrt)


# --- order statistics ----------------------------------------------------------

#: Fixed values of the continuous methods: the constants alpha and beta of their plotting positions.
PLOTTING = {"linear": (1, 1), "weibull": (0, 0), "hazen": (0.5, 0.5), "median_unbiased": (1 / 3, 1 / 3), "normal_unbiased": (3 / 8, 3 / 8), "interpolated_inverted_cdf": (0, 1)}


def quantile_of(find, n: Column, q: float, method: str = "linear") -> Column:
    """The q-quantile of n values; find gives the value at a place, from 1."""
    at = lambda k: find(F.greatest(F.least(k, n.cast("double")), F.lit(1.0)).cast("long"))
    if method in PLOTTING:
        alpha, beta = PLOTTING[method]
        place = n * q + (alpha + q * (1 - alpha - beta))
    elif method in ("lower", "higher", "nearest", "midpoint"):
        place = (n - 1) * q + 1
    elif method in ("inverted_cdf", "averaged_inverted_cdf", "closest_observation"):
        place = n * q - (0.5 if method == "closest_observation" else 0)
    else:
        raise ValueError(f"unknown method {method}")
    low = F.floor(place).cast("double")
    part = place - low
    if method == "lower":
        return at(low)
    if method == "higher":
        return at(F.ceil(place).cast("double"))
    if method == "nearest":
        return at(F.rint(place - 1) + 1)
    if method == "midpoint":
        return (at(low) + at(F.ceil(place).cast("double"))) / 2
    if method == "inverted_cdf":
        return F.when(part > 0, at(low + 1)).otherwise(at(low))
    if method == "averaged_inverted_cdf":
        return F.when(part > 0, at(low + 1)).otherwise((at(low) + at(low + 1)) / 2)
    if method == "closest_observation":
        odd = F.pmod(low, F.lit(2.0)) == 1
        return F.when((part == 0) & ~odd, at(low)).otherwise(at(low + 1))
    inside = F.greatest(F.least(place, n.cast("double")), F.lit(1.0))
    low = F.floor(inside).cast("double")
    return at(low) + (at(low + 1) - at(low)) * (inside - low)


def _whole_quantile(a: NdArray, q: float, method: str) -> NdArray:
    """Of all cells: equal values are counted first, and only the ranges of values around the quantile's place are sorted."""
    values = a.cells.where("v IS NOT NULL").select(F.col("v").cast("double").alias("v"))
    counted = values.groupBy("v").agg(F.count(F.lit(1)).alias("c")).withColumn("r", range_of(F.col("v"), range_cuts(values)))
    by_range = Window.orderBy("r")
    ranges = counted.groupBy("r").agg(F.sum("c").alias("t"), F.bool_or(F.isnan("v")).alias("nan"))  # a row a range
    ranges = ranges.select(
        "r", "t", F.coalesce(F.sum("t").over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("t").over(by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"),
        F.bool_or("nan").over(by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("nan"),
    )
    place = F.floor(F.col("n") * q)  # no method looks farther than two places from here
    around = lambda first, last: (last >= place - 2) & (first <= place + 3)
    near = counted.join(F.broadcast(ranges.where(around(F.col("before") + 1, F.col("before") + F.col("t")))), "r")  # a few rows
    near = near.withColumn("last", F.col("before") + F.sum("c").over(Window.partitionBy("r").orderBy("v")))
    near = near.where(around(F.col("last") - F.col("c") + 1, F.col("last")))
    found = near.agg(F.array_sort(F.collect_list(F.struct("last", "v"))).alias("s"), F.max("n").alias("n"), F.max("nan").alias("nan"))
    at = lambda k: F.element_at(F.filter("s", lambda x: x["last"] >= k), 1)["v"]
    value = F.when(F.col("n").isNull() | F.col("nan"), NAN).otherwise(quantile_of(at, F.col("n"), q, method))
    return NdArray(found.select(value.alias("v")), ())


def quantile(a: NdArray, q: float, axis=None, method: str = "linear", keepdims=False):
    """Over all axes by ranges of values, without a limit of memory; lanes that stay apart are sorted arrays of a task."""
    if not 0 <= q <= 1:
        raise ValueError("Quantiles must be in the range [0, 1]")
    if len(a.axes_of(axis)) == a.ndim:
        found = _whole_quantile(a, q, method)
        return reshape(found, [1] * a.ndim) if keepdims else found
    if method == "linear":
        return _reduced(a, axis, lambda v: _nan_if_any(v, F.percentile(v.cast("double"), q)), keepdims, NAN)
    found = _reduced(a, axis, lambda v: F.struct(F.array_sort(F.collect_list(v.cast("double"))).alias("s"), F.count(v).alias("n"), F.bool_or(F.isnan(v.cast("double"))).alias("nan")), keepdims)
    return found.map(lambda s: F.when(s["nan"] | (s["n"] == 0), NAN).otherwise(quantile_of(lambda k: F.get(s["s"], (k - 1).cast("int")), s["n"], q, method)))


def percentile(a: NdArray, q: float, axis=None, method: str = "linear", keepdims=False):
    return quantile(a, q / 100, axis, method, keepdims)


def median(a: NdArray, axis=None, keepdims=False):
    return quantile(a, 0.5, axis, keepdims=keepdims)


def nanquantile(a: NdArray, q: float, axis=None, method: str = "linear", keepdims=False):
    return quantile(_without_nan(a), q, axis, method, keepdims)


def nanpercentile(a: NdArray, q: float, axis=None, method: str = "linear", keepdims=False):
    return nanquantile(a, q / 100, axis, method, keepdims)


def nanmedian(a: NdArray, axis=None, keepdims=False):
    return nanquantile(a, 0.5, axis, keepdims=keepdims)


# --- scans ---------------------------------------------------------------------

BLOCK = 1 << 16


def _scan(a: NdArray, axis, aggregate, combine, start) -> NdArray:
    """A running aggregate. A lane is cut into blocks of places: sums of blocks are scanned, then each block in its own task."""
    if axis is None:
        a, axis = ravel(a), 0
    name = f"i{a.axis(axis)}"
    lanes = [x for x in a.axes if x != name]
    if a.shape[a.axis(axis)] <= BLOCK and lanes:
        w = Window.partitionBy(*lanes).orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
        return NdArray(a.cells.withColumn("v", aggregate(F.col("v")).over(w)), a.shape)
    cells = a.cells.withColumn("_block", F.floor(F.col(name) / BLOCK))
    totals = cells.groupBy(*lanes, "_block").agg(aggregate(F.col("v")).alias("_t"))
    w = Window.partitionBy(*lanes).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*lanes, "_block", F.coalesce(aggregate(F.col("_t")).over(w), F.lit(start)).alias("_before"))
    within = Window.partitionBy(*lanes, "_block").orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
    out = cells.join(before, [*lanes, "_block"]).withColumn("v", combine(F.col("_before"), aggregate(F.col("v")).over(within)))
    return NdArray(out.select(*a.axes, "v"), a.shape)


def cumsum(a: NdArray, axis=None):
    return _scan(a, axis, F.sum, lambda x, y: x + y, 0)


def cumprod(a: NdArray, axis=None):
    return _scan(a, axis, lambda v: F.product(v.cast("double")), lambda x, y: x * y, 1.0)


def nancumsum(a: NdArray, axis=None):
    return cumsum(a.map(lambda v: F.nanvl(v, F.lit(0.0))), axis)


def nancumprod(a: NdArray, axis=None):
    return cumprod(a.map(lambda v: F.nanvl(v, F.lit(1.0))), axis)


def maximum_accumulate(a: NdArray, axis=0):
    return _scan(a, axis, F.max, lambda x, y: F.greatest(x, y), None)


def minimum_accumulate(a: NdArray, axis=0):
    return _scan(a, axis, F.min, lambda x, y: F.least(x, y), None)


def cumulative_sum(a: NdArray, axis=None, include_initial: bool = False):
    if axis is None and a.ndim > 1:
        raise ValueError("axis is required for arrays of more than one dimension")
    out = cumsum(a, axis or 0)
    return _with_first(out, axis or 0, 0) if include_initial else out


def cumulative_prod(a: NdArray, axis=None, include_initial: bool = False):
    out = cumprod(a, axis or 0)
    return _with_first(out, axis or 0, 1) if include_initial else out


def _with_first(a: NdArray, axis: int, value) -> NdArray:
    from tessera.operators.array import concatenate, grid

    shape = tuple(1 if k == a.axis(axis) else d for k, d in enumerate(a.shape))
    return concatenate([grid(a.spark, shape, F.lit(value).cast(a.dtype)), a], axis)


def diff(a: NdArray, n: int = 1, axis: int = -1) -> NdArray:
    for _ in range(n):
        name = f"i{a.axis(axis)}"
        lanes = [x for x in a.axes if x != name]
        # The next neighbour's value by an equality join: no lane is gathered in one task.
        following = a.cells.select(*lanes, (F.col(name) - 1).alias(name), F.col("v").alias("_n"))
        cells = a.cells.join(following, a.axes).select(*a.axes, (F.col("_n") - F.col("v")).alias("v"))
        a = NdArray(cells, tuple(max(0, d - 1) if k == a.axis(axis) else d for k, d in enumerate(a.shape)))
    return a


def ediff1d(a: NdArray, to_end=None, to_begin=None) -> NdArray:
    from tessera.operators.array import array, concatenate

    parts = [diff(ravel(a))]
    if to_begin is not None:
        parts.insert(0, array(a.spark, list(to_begin), a.dtype))
    if to_end is not None:
        parts.append(array(a.spark, list(to_end), a.dtype))
    return concatenate(parts) if len(parts) > 1 else parts[0]


def unwrap(a: NdArray, period: float = 6.283185307179586, discont: float | None = None, axis: int = -1) -> NdArray:
    """Add multiples of the period so that steps stay within half of it."""
    name = f"i{a.axis(axis)}"
    lanes = [x for x in a.axes if x != name]
    half, limit = period / 2, max(discont if discont is not None else period / 2, period / 2)
    previous = a.cells.select(*lanes, (F.col(name) + 1).alias(name), F.col("v").alias("_p"))
    step = F.col("v") - F.col("_p")
    wrapped = step + half - F.floor((step + half) / period) * period - half
    wrapped = F.when((wrapped == -half) & (step > 0), half).otherwise(wrapped)
    change = F.when(F.col("_p").isNull() | (F.abs(step) < limit), 0.0).otherwise(wrapped - step)
    cells = a.cells.join(previous, a.axes, "left").withColumn("_c", change)
    total = cumsum(NdArray(cells.select(*a.axes, F.col("_c").alias("v")), a.shape), axis)
    return a.zip(total, lambda v, c: v + c)


# --- sorting and searching -----------------------------------------------------


def _lane_ranks(a: NdArray, axis: int, descending: bool) -> DataFrame:
    name = f"i{a.axis(axis)}"
    lanes = [x for x in a.axes if x != name]
    if not lanes:
        return dense_rank_positions(a.cells, [F.col("v"), F.col(name)], descending=descending)
    value = F.desc_nulls_last("v") if descending else F.asc_nulls_last("v")
    return a.cells.withColumn("pos", F.row_number().over(Window.partitionBy(*lanes).orderBy(value, name)).cast("long") - 1)


def sort(a: NdArray, axis: int | None = -1, descending: bool = False) -> NdArray:
    """NaN sorts last, NULL after it; the order of ties is that of their places."""
    if axis is None:
        a, axis = ravel(a), 0
    name = f"i{a.axis(axis)}"
    return NdArray(_lane_ranks(a, axis, descending).withColumn(name, F.col("pos")).select(*a.axes, "v"), a.shape)


def argsort(a: NdArray, axis: int | None = -1, descending: bool = False) -> NdArray:
    if axis is None:
        a, axis = ravel(a), 0
    name = f"i{a.axis(axis)}"
    return NdArray(_lane_ranks(a, axis, descending).withColumn("v", F.col(name)).withColumn(name, F.col("pos")).select(*a.axes, "v"), a.shape)


def lexsort(keys: list[NdArray]) -> NdArray:
    """Places in the order of several keys, the last one first."""
    table = keys[0].cells.withColumnRenamed("v", "_k0")
    for n, k in enumerate(keys[1:], 1):
        table = table.join(k.cells.withColumnRenamed("v", f"_k{n}"), "i0")
    placed = dense_rank_positions(table, [*[F.col(f"_k{n}") for n in reversed(range(len(keys)))], F.col("i0")])
    return NdArray(placed.select(F.col("pos"), F.col("i0").alias("v")).withColumnRenamed("pos", "i0"), keys[0].shape)


def sort_complex(a: NdArray) -> NdArray:
    placed = dense_rank_positions(a.cells, [F.col("v.re"), F.col("v.im"), F.col("i0")])
    return NdArray(placed.select(F.col("pos").alias("i0"), "v"), a.shape)


def searchsorted(a: NdArray, v: NdArray, side: str = "left") -> NdArray:
    """Insertion points: the number of values below (left) or not above (right), by ranks in the union of both.

    Values and needles are ranked together, so there is no range join.
    """
    values = a.cells.select(F.col("v").alias("x"), F.lit(1).alias("n"), F.lit(None).cast("long").alias("p"), F.lit(1 if side == "left" else 0).alias("late"))
    needles = v.cells.select(F.col("v").alias("x"), F.lit(0).alias("n"), F.col("i0").alias("p"), F.lit(0 if side == "left" else 1).alias("late"))
    both = dense_rank_positions(values.unionByName(needles), [F.col("x"), F.col("late"), F.coalesce(F.col("p"), F.lit(-1))])
    among = NdArray(both.select(F.col("pos").alias("i0"), F.col("n").cast("long").alias("v")), (a.size + v.size,))
    counted = cumsum(among).cells.withColumnRenamed("v", "c").withColumnRenamed("i0", "pos")
    return NdArray(both.where("p IS NOT NULL").select("p", "pos").join(counted, "pos").select(F.col("p").alias("i0"), F.col("c").alias("v")), v.shape)


def digitize(x: NdArray, bins: list[float], right: bool = False) -> NdArray:
    """The bin of each value, among increasing edges on the driver."""
    edges = F.array(*[F.lit(float(b)) for b in bins])
    return x.map(lambda v: F.size(F.filter(edges, (lambda e: e < v) if right else (lambda e: e <= v))))


def bincount(x: NdArray) -> NdArray:
    n = int(x.cells.agg(F.coalesce(F.max("v"), F.lit(-1))).first()[0]) + 1
    from tessera.operators.array import grid

    counts = x.cells.groupBy(F.col("v").cast("long").alias("i0")).agg(F.count(F.lit(1)).alias("c"))
    return NdArray(grid(x.spark, (n,), 0).cells.drop("v").join(counts, "i0", "left").select("i0", F.coalesce("c", F.lit(0)).alias("v")), (n,))


def histogram(x: NdArray, bins: int, low: float, high: float) -> NdArray:
    from tessera.operators.array import grid

    width = (high - low) / bins
    bin_ = F.when(F.col("v") == high, bins - 1).otherwise(F.floor((F.col("v") - low) / width)).cast("long")
    counts = x.cells.where(F.col("v").between(low, high)).groupBy(bin_.alias("i0")).agg(F.count(F.lit(1)).alias("c"))
    return NdArray(grid(x.spark, (bins,), 0).cells.drop("v").join(counts, "i0", "left").select("i0", F.coalesce("c", F.lit(0)).alias("v")), (bins,))


def top_k(a: NdArray, k: int) -> DataFrame:
    """The k largest cells: partial tops in each task."""
    return a.cells.orderBy(F.desc("v"), *a.axes).limit(k)


# --- ufunc methods -------------------------------------------------------------


def reduceat(a: NdArray, starts: list[int], make=F.sum) -> NdArray:
    """Aggregates of the slices between starts; a start that isn't below the next is a single cell."""
    ends = [s if t <= s else t - 1 for s, t in zip(starts, [*starts[1:], a.size])]
    spans = a.spark.createDataFrame([(k, s, e) for k, (s, e) in enumerate(zip(starts, ends))], "k bigint, s bigint, e bigint")
    # Segments are expanded to the places they cover: an equality join instead of a range join.
    places = spans.select("k", F.explode(F.sequence("s", "e")).alias("i0"))
    return NdArray(a.cells.join(places, "i0").groupBy(F.col("k").alias("i0")).agg(make(F.col("v")).alias("v")), (len(starts),))


def at(a: NdArray, index: NdArray, values: NdArray, make=F.sum, combine=lambda x, y: x + y) -> NdArray:
    """Unbuffered update: repeated indices count each."""
    updates = index.cells.withColumnRenamed("v", "j").join(values.cells.withColumnRenamed("v", "w"), "i0").groupBy(F.col("j").cast("long").alias("i0")).agg(make(F.col("w")).alias("w"))
    return NdArray(a.cells.join(updates, "i0", "left").select("i0", F.when(F.col("w").isNull(), F.col("v")).otherwise(combine(F.col("v"), F.col("w"))).alias("v")), a.shape)
