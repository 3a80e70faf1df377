"""Arrays as cell tables: a row for each cell, with coordinates i0, i1, … and a value v.

The shape is known on the driver, the cells are a DataFrame. All operators return new
arrays; nothing is computed before an action. Axes count from the end if negative.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.work import new_folder


class AxisError(ValueError, IndexError):
    """An axis that the array doesn't have."""


def axis_names(n: int) -> list[str]:
    return [f"i{k}" for k in range(n)]


def strides(shape: Sequence[int]) -> list[int]:
    out, step = [], 1
    for d in reversed(shape):
        out.append(step)
        step *= max(1, d)
    return out[::-1]


#: Cells that a join broadcasts at most; the planner decides on no more than so many.
FEW = 1 << 15
#: Cells that a task makes of fewer ones.
TASK = 1 << 20


@dataclass(frozen=True)
class NdArray:
    """cells: columns i0 … and v; every cell has a row. once: the array before broadcast_to repeated it."""

    cells: DataFrame
    shape: tuple[int, ...]
    once: NdArray | None = None

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def axes(self) -> list[str]:
        return axis_names(self.ndim)

    @property
    def dtype(self) -> str:
        return self.cells.schema["v"].dataType.simpleString()

    @property
    def spark(self) -> SparkSession:
        return self.cells.sparkSession

    @property
    def T(self) -> NdArray:
        return transpose(self)

    def axis(self, k: int) -> int:
        if not -self.ndim <= k < self.ndim:
            raise AxisError(f"axis {k} is out of bounds for array of dimension {self.ndim}")
        return k % self.ndim

    def axes_of(self, axis) -> list[int]:
        if axis is None:
            return list(range(self.ndim))
        return [self.axis(k) for k in (axis if isinstance(axis, Iterable) else [axis])]

    def map(self, f) -> NdArray:
        """Apply a Column function to all values."""
        return NdArray(self.cells.withColumn("v", f(F.col("v"))), self.shape)

    def astype(self, kind: str) -> NdArray:
        return self.map(lambda v: v.cast(kind))

    def zip(self, other: NdArray, f) -> NdArray:
        """Apply a Column function to the values of two arrays, broadcast together.

        Cells aren't repeated before the join: each side meets the other on the axes that both have.
        """
        shape = broadcast_shapes(self.shape, other.shape)
        a, b = _once(self, len(shape)), _once(other, len(shape))
        met = broadcast_shapes(a.shape, b.shape)
        if min(a.size, b.size) > FEW and met not in (a.shape, b.shape):  # else few keys would hold all rows
            a, b = (broadcast_to(a, met), b) if a.size >= b.size else (a, broadcast_to(b, met))
        x, y = [c.cells.select(*[n for n, d in zip(c.axes, c.shape) if d != 1], F.col("v").alias(v)) for c, v in ((a, "_a"), (b, "_b"))]
        joined = meet(x, y, [n for n in x.columns if n in y.columns], a.size, b.size, math.prod(met))
        axes = [F.lit(0).cast("long").alias(n) if d == 1 else F.col(n) for n, d in zip(axis_names(len(met)), met)]
        return broadcast_to(NdArray(joined.select(*axes, f(F.col("_a"), F.col("_b")).alias("v")), met), shape)

    def lin(self) -> Column:
        return linear(self.axes, self.shape)

    def tolist(self):
        """Nested lists, in order."""
        values = [r["v"] for r in (self.cells.orderBy(*self.axes) if self.ndim else self.cells).select("v").collect()]

        def nest(depth: int, at: int):
            if depth == self.ndim:
                return values[at]
            return [nest(depth + 1, at + k * strides(self.shape)[depth]) for k in range(self.shape[depth])]

        return nest(0, 0)

    def item(self):
        if self.size != 1:
            raise ValueError("only an array of size 1 is one item")
        return self.cells.first()["v"]

    #: Bytes of a cell's value by type.
    _BYTES = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "struct<re:double,im:double>": 16}

    @property
    def itemsize(self) -> int:
        return self._BYTES[self.dtype]

    @property
    def nbytes(self) -> int:
        return self.size * self.itemsize

    @property
    def base(self):
        """Arrays are values: none is a view of another."""
        return None

    def __copy__(self) -> NdArray:
        return copy(self)

    def __deepcopy__(self, memo) -> NdArray:
        return copy(self)

    def fill(self, value) -> NdArray:
        """A new array of this shape and type with one value."""
        return self.map(lambda v: F.lit(value).cast(self.dtype))

    def tobytes(self) -> bytes:
        """The values in row order as little-endian bytes; for arrays that fit the driver."""
        import numpy as np

        from tessera.functions.types import numpy_dtype

        return np.array(self.tolist(), numpy_dtype(self.dtype)).tobytes()

    def __iter__(self):
        """The subarrays along the first axis."""
        if not self.ndim:
            raise TypeError("iteration over a 0-d array")
        return (take_index(self, k) for k in range(self.shape[0]))

    def __len__(self) -> int:
        if not self.ndim:
            raise TypeError("len() of unsized object")
        return self.shape[0]

    def __add__(self, other):
        return self.zip(other, lambda a, b: a + b) if isinstance(other, NdArray) else self.map(lambda v: v + other)

    def __sub__(self, other):
        return self.zip(other, lambda a, b: a - b) if isinstance(other, NdArray) else self.map(lambda v: v - other)

    def __mul__(self, other):
        return self.zip(other, lambda a, b: a * b) if isinstance(other, NdArray) else self.map(lambda v: v * other)

    def __truediv__(self, other):
        from tessera.functions.ufuncs import divide

        return self.zip(other, divide) if isinstance(other, NdArray) else self.map(lambda v: divide(v, F.lit(other)))

    def __neg__(self):
        return self.map(lambda v: -v)

    def __getitem__(self, key) -> NdArray:
        return getitem(self, key)


def linear(names: Sequence[str], shape: Sequence[int]) -> Column:
    """The position in row order of coordinates."""
    out = F.lit(0).cast("long")
    for name, step in zip(names, strides(shape)):
        out = out + F.col(name) * step
    return out


def unlinear(lin: Column, shape: Sequence[int]) -> list[Column]:
    return [F.pmod(F.floor(lin / step), F.lit(max(1, d))).cast("long").alias(f"i{k}") for k, (d, step) in enumerate(zip(shape, strides(shape)))]


def _once(a: NdArray, ndim: int) -> NdArray:
    """The array before it was repeated, with leading axes of length 1."""
    a = a if a.once is None else a.once
    return reshape(a, (1,) * (ndim - a.ndim) + a.shape) if a.ndim < ndim else a


def meet(x: DataFrame, y: DataFrame, on, nx: int, ny: int, out: int) -> DataFrame:
    """Join tables of at most nx and ny cells to about `out` rows; their last columns are the values. on: names, a condition, or nothing.

    The planner doesn't see how often a sequence repeats a row and would have the driver build a broadcast of all of
    them, but the shapes say how many cells there are: FEW at most are broadcast, more are merged.
    """
    cross = isinstance(on, list) and not on
    join = lambda p, q: p.crossJoin(q) if cross else p.join(q, on)
    if min(nx, ny) > FEW:
        return join(x, y) if cross else join(x.hint("merge"), y)
    small, large = (x, y) if nx < ny else (y, x)
    if not cross and max(nx, ny, out) <= FEW or small.schema[-1].dataType.simpleString() not in NdArray._BYTES:
        return join(x, y)
    most = max(nx, ny)
    parts = min(-(-out // TASK), most // 256)
    if parts > 1 and 4 * most <= out and most <= 4 * TASK:  # few rows lie in few parts, whatever comes of them
        large = large.repartition(parts, *large.columns[:-1])
    return join(F.broadcast(x), large) if small is x else join(large, F.broadcast(y))


def kept(a: NdArray, label: str) -> NdArray:
    """The array written to a work table and read back: what is made of it doesn't compute it again."""
    folder = new_folder(a.spark, label)
    a.cells.write.parquet(folder)
    return NdArray(a.spark.read.parquet(folder), a.shape)


# --- creation ------------------------------------------------------------------


def grid(spark: SparkSession, shape: Sequence[int], value) -> NdArray:
    """An array whose value is an expression of the coordinates (and of id, the linear position)."""
    shape = tuple(shape)
    base = spark.range(math.prod(shape))
    return NdArray(base.select("id", *unlinear(F.col("id"), shape)).select(*axis_names(len(shape)), (value if isinstance(value, Column) else F.lit(value)).alias("v")), shape)


def zeros(spark, shape, kind="double"):
    return grid(spark, shape, F.lit(0).cast(kind))


empty = zeros


def ones(spark, shape, kind="double"):
    return grid(spark, shape, F.lit(1).cast(kind))


def full(spark, shape, value):
    return grid(spark, shape, F.lit(value))


def zeros_like(a: NdArray):
    return a.map(lambda v: F.lit(0).cast(a.dtype))


empty_like = zeros_like


def ones_like(a: NdArray):
    return a.map(lambda v: F.lit(1).cast(a.dtype))


def full_like(a: NdArray, value):
    return a.map(lambda v: F.lit(value).cast(a.dtype))


def arange(spark, start, stop=None, step=1):
    start, stop = (0, start) if stop is None else (start, stop)
    n = max(0, math.ceil((stop - start) / step))
    return grid(spark, (n,), F.lit(start) + F.col("id") * F.lit(step))


def linspace(spark, start: float, stop: float, num: int = 50, endpoint: bool = True):
    step = (stop - start) / max(1, num - 1 if endpoint else num)
    value = F.lit(float(start)) + F.col("id") * F.lit(step)
    return grid(spark, (num,), F.when((F.col("id") == num - 1) & F.lit(endpoint and num > 1), float(stop)).otherwise(value))


def logspace(spark, start, stop, num=50, endpoint=True, base=10.0):
    return linspace(spark, start, stop, num, endpoint).map(lambda v: F.pow(F.lit(base), v))


def geomspace(spark, start, stop, num=50, endpoint=True):
    return logspace(spark, math.log10(start), math.log10(stop), num, endpoint)


def eye(spark, n: int, m: int | None = None, k: int = 0):
    return _coordinates(spark, (n, n if m is None else m), lambda c: F.when(c[1] - c[0] == k, 1.0).otherwise(0.0))


def _coordinates(spark, shape, f) -> NdArray:
    names = axis_names(len(shape))
    cells = spark.range(math.prod(shape)).select(*unlinear(F.col("id"), shape))
    return NdArray(cells.withColumn("v", f([F.col(n) for n in names])), tuple(shape))


def identity(spark, n: int):
    return eye(spark, n)


def tri(spark, n: int, m: int | None = None, k: int = 0):
    return _coordinates(spark, (n, n if m is None else m), lambda c: F.when(c[1] - c[0] <= k, 1.0).otherwise(0.0))


def indices(spark, shape) -> list[NdArray]:
    return [_coordinates(spark, shape, lambda c, k=k: c[k]) for k in range(len(shape))]


def diag_indices(spark, n: int, ndim: int = 2):
    return [arange(spark, n)] * ndim


def diag_indices_from(a: NdArray):
    if a.ndim < 2 or len(set(a.shape)) != 1:
        raise ValueError("All dimensions of input must be of equal length")
    return diag_indices(a.spark, a.shape[0], a.ndim)


def tril_indices(spark, n: int, k: int = 0, m: int | None = None) -> DataFrame:
    return tri(spark, n, m, k).cells.where("v = 1").select("i0", "i1")


def triu_indices(spark, n: int, k: int = 0, m: int | None = None) -> DataFrame:
    return tri(spark, n, m, k - 1).cells.where("v = 0").select("i0", "i1")


def array(spark: SparkSession, nested, kind: str | None = None) -> NdArray:
    """Ingest nested sequences or anything that numpy takes; the driver holds it, so it is for small arrays."""
    import numpy as np

    a = np.asarray(nested)
    names = axis_names(a.ndim)
    rows = [(*map(int, at), a[at].item()) for at in np.ndindex(*a.shape)]
    kind = kind or {"b": "boolean", "i": "bigint", "u": "bigint", "f": "double"}.get(a.dtype.kind, "string")
    return NdArray(spark.createDataFrame(rows, ", ".join([*(f"{n} bigint" for n in names), f"v {kind}"])), a.shape)


def from_column(frame: DataFrame, order: Sequence[str], value: str) -> NdArray:
    """A column as a 1-D array, in the order of a unique key. Positions come from ranges of the key, not from one sorted task."""
    cells = dense_rank_positions(frame.select(*order, F.col(value).alias("v")), [F.col(o) for o in order])
    return NdArray(cells.select(F.col("pos").alias("i0"), "v"), (frame.count(),))


def range_cuts(values: DataFrame, ranges: int | None = None) -> list:
    """Increasing values of the only column that cut it into ranges of about equal rows.

    Numbers are cut at approximate quantiles, other types at those of a sample of about 100 rows a range.
    """
    ranges = ranges or int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if ranges <= 1:
        return []
    o, kind = F.col(values.columns[0]), values.schema[0].dataType.typeName()
    if kind in ("double", "float", "long", "integer", "short", "byte"):
        known = values.select(o.cast("double").alias("o")).where("o IS NOT NULL AND NOT isnan(o)")
        return sorted({float(c) for c in known.approxQuantile("o", [k / ranges for k in range(1, ranges)], 0.01)})
    if kind not in ("string", "binary", "date", "timestamp", "timestamp_ntz", "decimal", "boolean"):
        return []
    known = values.select((F.substring(o, 1, 64) if kind == "string" else o).alias("o")).where("o IS NOT NULL")  # long texts needn't reach the driver whole
    rows = known.count()
    some = [r.o for r in known.sample(min(1.0, 100 * ranges / max(rows, 1)), seed=7).orderBy("o").collect()]
    return sorted({some[k * len(some) // ranges] for k in range(1, ranges)}) if some else []


def range_of(value: Column, cuts: list) -> Column:
    """The number of the value's range: NaN is in the last one, NULL in one after it."""
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= value)) if cuts else F.lit(0)
    return F.when(value.isNull(), len(cuts) + 1).otherwise(part).cast("int")


def dense_rank_positions(frame: DataFrame, order: Sequence[Column], ranges: int | None = None, descending: bool = False) -> DataFrame:
    """Adds pos, the row's place in a total order, from 0; NULLs of the first column come last.

    The first ordering column is cut into ranges; a row's place is the number of rows in the ranges
    before it (a small table) and its place in its range. So no task sorts all rows.
    descending: the first column's greatest values come first.
    """
    first = frame.select(order[0].alias("o"))
    cuts = range_cuts(first, ranges)
    numeric = first.schema["o"].dataType.typeName() in ("double", "float", "long", "integer", "short", "byte")
    part = range_of(order[0].cast("double") if numeric else order[0], cuts)
    if descending:
        part = F.when(order[0].isNull(), part).otherwise(len(cuts) - part)
    marked = frame.withColumn("_range", part)
    counts = marked.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_range", "_before")
    leading = F.desc(order[0]) if descending else order[0]
    placed = marked.withColumn("_row", F.row_number().over(Window.partitionBy("_range").orderBy(leading, *order[1:])))
    return placed.join(F.broadcast(before), "_range").withColumn("pos", F.col("_before") + F.col("_row") - 1).drop("_range", "_before", "_row")  # a row a range


def copy(a: NdArray) -> NdArray:
    """Arrays don't change: a copy is a new name for the same cells."""
    return NdArray(a.cells, a.shape)


ascontiguousarray = asfortranarray = copy  # cells have no order in memory


# --- what an object is: decided on the driver --------------------------------


def iscomplexobj(a) -> bool:
    return a.dtype.startswith("struct<re") if isinstance(a, NdArray) else isinstance(a, complex)


def isrealobj(a) -> bool:
    return not iscomplexobj(a)


def isfortran(a: NdArray) -> bool:
    """Cell tables have coordinates and no strides; none is in column order only."""
    return False


def isscalar(x) -> bool:
    return isinstance(x, (int, float, complex, str, bytes, bool))


def iterable(x) -> bool:
    return (x.ndim > 0) if isinstance(x, NdArray) else hasattr(x, "__iter__")


def shares_memory(a, b) -> bool:
    """Whether both are read from the same plan; nothing written to one shows in the other."""
    return isinstance(a, NdArray) and isinstance(b, NdArray) and a.cells.sameSemantics(b.cells)


may_share_memory = shares_memory


# --- shape ---------------------------------------------------------------------


def reshape(a: NdArray, shape) -> NdArray:
    shape = tuple(shape) if isinstance(shape, Iterable) else (shape,)
    if -1 in shape:
        rest = math.prod(d for d in shape if d != -1)
        shape = tuple(a.size // rest if d == -1 else d for d in shape)
    if math.prod(shape) != a.size:
        raise ValueError(f"cannot reshape array of size {a.size} into shape {shape}")
    return NdArray(a.cells.select(a.lin().alias("_lin"), "v").select(*unlinear(F.col("_lin"), shape), "v"), shape)


def ravel(a: NdArray) -> NdArray:
    return reshape(a, (a.size,))


flatten = ravel


def transpose(a: NdArray, axes=None) -> NdArray:
    axes = [a.axis(k) for k in axes] if axes is not None else list(range(a.ndim))[::-1]
    return NdArray(a.cells.select(*[F.col(f"i{k}").alias(f"i{n}") for n, k in enumerate(axes)], "v"), tuple(a.shape[k] for k in axes))


permute_dims = transpose


def matrix_transpose(a: NdArray) -> NdArray:
    return swapaxes(a, -1, -2)


def swapaxes(a: NdArray, x: int, y: int) -> NdArray:
    order = list(range(a.ndim))
    x, y = a.axis(x), a.axis(y)
    order[x], order[y] = order[y], order[x]
    return transpose(a, order)


def moveaxis(a: NdArray, source, destination) -> NdArray:
    source, destination = a.axes_of(source), a.axes_of(destination)
    order = [k for k in range(a.ndim) if k not in source]
    for d, s in sorted(zip(destination, source)):
        order.insert(d, s)
    return transpose(a, order)


def rollaxis(a: NdArray, axis: int, start: int = 0) -> NdArray:
    axis = a.axis(axis)
    start = start + a.ndim if start < 0 else start
    return moveaxis(a, axis, start - 1 if axis < start else start)


def _renamed(a: NdArray, columns: list[Column], shape) -> NdArray:
    return NdArray(a.cells.select(*[c.cast("long").alias(f"i{k}") for k, c in enumerate(columns)], "v"), tuple(shape))


def squeeze(a: NdArray, axis=None) -> NdArray:
    gone = [k for k in range(a.ndim) if a.shape[k] == 1] if axis is None else a.axes_of(axis)
    if any(a.shape[k] != 1 for k in gone):
        raise ValueError("cannot select an axis to squeeze out which has size not equal to one")
    kept = [k for k in range(a.ndim) if k not in gone]
    return _renamed(a, [F.col(f"i{k}") for k in kept], [a.shape[k] for k in kept])


def expand_dims(a: NdArray, axis) -> NdArray:
    wanted = axis if isinstance(axis, Iterable) else [axis]
    n = a.ndim + len(list(wanted))
    new = {k % n for k in wanted}
    old = iter(range(a.ndim))
    parts = [(F.lit(0), 1) if k in new else (F.col(f"i{(o := next(old))}"), a.shape[o]) for k in range(n)]
    return _renamed(a, [c for c, _ in parts], [d for _, d in parts])


def atleast_1d(a):
    return a if a.ndim >= 1 else reshape(a, (1,))


def atleast_2d(a):
    return a if a.ndim >= 2 else reshape(a, (1, a.size))


def atleast_3d(a):
    return a if a.ndim >= 3 else reshape(a, (1, a.size, 1)) if a.ndim < 2 else reshape(a, (*a.shape, 1))


def broadcast_shapes(*shapes) -> tuple[int, ...]:
    out = []
    for dims in zip(*[(1,) * (max(map(len, shapes)) - len(s)) + tuple(s) for s in shapes]):
        sizes = {d for d in dims if d != 1}
        if len(sizes) > 1:
            raise ValueError("shape mismatch: objects cannot be broadcast to a single shape")
        out.append(sizes.pop() if sizes else 1)
    return tuple(out)


def broadcast_to(a: NdArray, shape) -> NdArray:
    """Repeat along axes of length 1: rows are multiplied by a sequence, without a join."""
    shape = tuple(shape)
    if shape == a.shape:
        return a
    if broadcast_shapes(a.shape, shape) != shape:
        raise ValueError(f"cannot broadcast {a.shape} to {shape}")
    out = reshape(a, (1,) * (len(shape) - a.ndim) + a.shape) if a.ndim < len(shape) else a
    cells = out.cells
    for k, (have, want) in enumerate(zip(out.shape, shape)):
        if have != want:
            cells = cells.withColumn(f"i{k}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(want - 1).cast("long")))) if want else cells.where("false")
    return NdArray(cells.select(*axis_names(len(shape)), "v"), shape, _once(a, len(shape)))


def broadcast_arrays(*arrays: NdArray) -> list[NdArray]:
    shape = broadcast_shapes(*[a.shape for a in arrays])
    return [a if a.shape == shape else broadcast_to(a, shape) for a in arrays]


def meshgrid(*vectors: NdArray, indexing: str = "xy") -> list[NdArray]:
    n = len(vectors)
    shape = [v.size for v in vectors]
    out = []
    for k, v in enumerate(vectors):
        place = [v.size if j == k else 1 for j in range(n)]
        out.append(broadcast_to(reshape(v, place), shape))
    return [swapaxes(o, 0, 1) for o in out] if indexing == "xy" and n > 1 else out


def ix_(*vectors: NdArray) -> list[NdArray]:
    n = len(vectors)
    return [reshape(v, [v.size if j == k else 1 for j in range(n)]) for k, v in enumerate(vectors)]


def concatenate(arrays: Sequence[NdArray], axis: int | None = 0) -> NdArray:
    if axis is None:
        arrays, axis = [ravel(a) for a in arrays], 0
    first = arrays[0]
    axis = first.axis(axis)
    offset, out = 0, None
    for a in arrays:
        if a.ndim != first.ndim or any(a.shape[k] != first.shape[k] for k in range(a.ndim) if k != axis):
            raise ValueError("all the input array dimensions except for the concatenation axis must match exactly")
        moved = a.cells.withColumn(f"i{axis}", F.col(f"i{axis}") + offset)
        out = moved if out is None else out.unionByName(moved)
        offset += a.shape[axis]
    return NdArray(out, tuple(offset if k == axis else d for k, d in enumerate(first.shape)))


concat = concatenate


def stack(arrays: Sequence[NdArray], axis: int = 0) -> NdArray:
    axis = axis % (arrays[0].ndim + 1)
    return concatenate([expand_dims(a, axis) for a in arrays], axis)


def vstack(arrays):
    return concatenate([atleast_2d(a) for a in arrays], 0)


row_stack = vstack


def hstack(arrays):
    arrays = [atleast_1d(a) for a in arrays]
    return concatenate(arrays, 0 if arrays[0].ndim == 1 else 1)


def dstack(arrays):
    return concatenate([atleast_3d(a) for a in arrays], 2)


def column_stack(arrays):
    return concatenate([reshape(a, (a.size, 1)) if a.ndim < 2 else a for a in arrays], 1)


def append(a: NdArray, values: NdArray, axis=None):
    return concatenate([a, values], axis)


def unstack(a: NdArray, axis: int = 0) -> list[NdArray]:
    return [take_index(a, k, axis) for k in range(a.shape[a.axis(axis)])]


def take_index(a: NdArray, index: int, axis: int = 0) -> NdArray:
    axis = a.axis(axis)
    index = index + a.shape[axis] if index < 0 else index
    if not 0 <= index < a.shape[axis]:
        raise IndexError(f"index {index} is out of bounds for axis {axis} with size {a.shape[axis]}")
    kept = [k for k in range(a.ndim) if k != axis]
    return _renamed(NdArray(a.cells.where(F.col(f"i{axis}") == index), a.shape), [F.col(f"i{k}") for k in kept], [a.shape[k] for k in kept])


def flip(a: NdArray, axis=None) -> NdArray:
    return NdArray(a.cells.withColumns({f"i{k}": a.shape[k] - 1 - F.col(f"i{k}") for k in a.axes_of(axis)}), a.shape)


def fliplr(a):
    return flip(a, 1)


def flipud(a):
    return flip(a, 0)


def rot90(a: NdArray, k: int = 1, axes=(0, 1)) -> NdArray:
    x, y = a.axis(axes[0]), a.axis(axes[1])
    return {0: lambda: a, 1: lambda: flip(swapaxes(a, x, y), x), 2: lambda: flip(a, (x, y)), 3: lambda: flip(swapaxes(a, x, y), y)}[k % 4]()


def roll(a: NdArray, shift, axis=None) -> NdArray:
    if axis is None:
        return reshape(roll(ravel(a), shift, 0), a.shape)
    shifts = shift if isinstance(shift, Iterable) else [shift] * len(a.axes_of(axis))
    out = a.cells
    for k, s in zip(a.axes_of(axis), shifts):
        out = out.withColumn(f"i{k}", F.pmod(F.col(f"i{k}") + int(s), F.lit(max(1, a.shape[k]))))
    return NdArray(out, a.shape)


def tile(a: NdArray, reps) -> NdArray:
    reps = tuple(reps) if isinstance(reps, Iterable) else (reps,)
    n = max(a.ndim, len(reps))
    a, reps = reshape(a, (1,) * (n - a.ndim) + a.shape), (1,) * (n - len(reps)) + reps
    cells = a.cells
    for k, r in enumerate(reps):
        cells = cells.withColumn(f"i{k}", F.explode(F.sequence(F.col(f"i{k}"), F.col(f"i{k}") + (r - 1) * a.shape[k], F.lit(max(1, a.shape[k])).cast("long")))) if r else cells.where("false")
    return NdArray(cells, tuple(d * r for d, r in zip(a.shape, reps)))


def repeat(a: NdArray, repeats, axis=None) -> NdArray:
    if axis is None:
        return repeat(ravel(a), repeats, 0)
    axis = a.axis(axis)
    name = f"i{axis}"
    counts = [repeats] * a.shape[axis] if isinstance(repeats, int) else list(repeats) * (a.shape[axis] if len(repeats) == 1 else 1)
    if isinstance(repeats, int):
        low, n = F.col(name) * repeats, F.lit(repeats)
    else:
        starts = [sum(counts[:k]) for k in range(len(counts))]
        at = (F.col(name) + 1).cast("int")
        low = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), at)
        n = F.element_at(F.array(*[F.lit(c) for c in counts]), at)
    cells = a.cells.withColumn("_low", low).withColumn("_n", n).where("_n > 0")
    cells = cells.withColumn(name, F.explode(F.sequence(F.col("_low"), F.col("_low") + F.col("_n") - 1))).drop("_low", "_n")
    return NdArray(cells, tuple(sum(counts) if k == axis else d for k, d in enumerate(a.shape)))


def resize(a: NdArray, shape) -> NdArray:
    shape = tuple(shape) if isinstance(shape, Iterable) else (shape,)
    n = math.prod(shape)
    whole = tile(ravel(a), -(-n // max(1, a.size)))
    return reshape(NdArray(whole.cells.where(F.col("i0") < n), (n,)), shape)


def diag(a: NdArray, k: int = 0) -> NdArray:
    if a.ndim == 1:
        n = a.size + abs(k)
        on = a.cells.select((F.col("i0") + max(0, -k)).alias("i0"), (F.col("i0") + max(0, k)).alias("i1"), "v")
        zero = _coordinates(a.spark, (n, n), lambda c: F.lit(0).cast(a.dtype)).cells.where(F.col("i1") - F.col("i0") != k)
        return NdArray(on.unionByName(zero), (n, n))
    return diagonal(a, k)


def diagflat(a: NdArray, k: int = 0):
    return diag(ravel(a), k)


def diagonal(a: NdArray, offset: int = 0, axis1: int = 0, axis2: int = 1) -> NdArray:
    x, y = a.axis(axis1), a.axis(axis2)
    rest = [k for k in range(a.ndim) if k not in (x, y)]
    n = max(0, min(a.shape[x] - max(0, -offset), a.shape[y] - max(0, offset)))
    on = NdArray(a.cells.where(F.col(f"i{y}") - F.col(f"i{x}") == offset), a.shape)
    return _renamed(on, [*[F.col(f"i{k}") for k in rest], F.least(F.col(f"i{x}"), F.col(f"i{y}"))], [*[a.shape[k] for k in rest], n])


def tril(a: NdArray, k: int = 0):
    return NdArray(a.cells.withColumn("v", F.when(F.col(a.axes[-1]) - F.col(a.axes[-2]) <= k, F.col("v")).otherwise(F.lit(0).cast(a.dtype))), a.shape)


def triu(a: NdArray, k: int = 0):
    return NdArray(a.cells.withColumn("v", F.when(F.col(a.axes[-1]) - F.col(a.axes[-2]) >= k, F.col("v")).otherwise(F.lit(0).cast(a.dtype))), a.shape)


def fill_diagonal(a: NdArray, value):
    same = F.lit(True)
    for n in a.axes[1:]:
        same = same & (F.col(n) == F.col("i0"))
    return NdArray(a.cells.withColumn("v", F.when(same, F.lit(value).cast(a.dtype)).otherwise(F.col("v"))), a.shape)


def array_split(a: NdArray, sections, axis: int = 0) -> list[NdArray]:
    axis = a.axis(axis)
    n = a.shape[axis]
    if isinstance(sections, int):
        each, more = divmod(n, sections)
        cuts = [0]
        for k in range(sections):
            cuts.append(cuts[-1] + each + (k < more))
    else:
        cuts = [0, *[min(max(c + n if c < 0 else c, 0), n) for c in sections], n]
    out = []
    for low, high in zip(cuts, cuts[1:]):
        part = a.cells.where((F.col(f"i{axis}") >= low) & (F.col(f"i{axis}") < high)).withColumn(f"i{axis}", F.col(f"i{axis}") - low)
        out.append(NdArray(part, tuple(max(0, high - low) if k == axis else d for k, d in enumerate(a.shape))))
    return out


def split(a: NdArray, sections, axis: int = 0):
    if isinstance(sections, int) and a.shape[a.axis(axis)] % sections:
        raise ValueError("array split does not result in an equal division")
    return array_split(a, sections, axis)


def hsplit(a, sections):
    return split(a, sections, 0 if a.ndim == 1 else 1)


def vsplit(a, sections):
    return split(a, sections, 0)


def dsplit(a, sections):
    return split(a, sections, 2)


def pad(a: NdArray, width: int, value=0) -> NdArray:
    """Constant padding on all sides."""
    shape = tuple(d + 2 * width for d in a.shape)
    inside = F.lit(True)
    for n, d in zip(a.axes, a.shape):
        inside = inside & F.col(n).between(width, width + d - 1)
    border = _coordinates(a.spark, shape, lambda c: F.lit(value).cast(a.dtype)).cells.where(~inside)
    return NdArray(a.cells.withColumns({n: F.col(n) + width for n in a.axes}).unionByName(border), shape)


def insert(a: NdArray, index: int, values: NdArray, axis: int | None = None) -> NdArray:
    if axis is None:
        a, axis = ravel(a), 0
    head, tail = array_split(a, [index], axis)
    return concatenate([head, values, tail], axis)


def delete(a: NdArray, obj, axis: int | None = None) -> NdArray:
    """Drop indices along an axis; places are renumbered by counting the dropped ones below."""
    if axis is None:
        a, axis = ravel(a), 0
    axis = a.axis(axis)
    n = a.shape[axis]
    wanted = range(*obj.indices(n)) if isinstance(obj, slice) else obj if isinstance(obj, Iterable) else [obj]
    gone = sorted({k + n if k < 0 else k for k in wanted})
    if any(not 0 <= k < n for k in gone):
        raise IndexError("index out of bounds")
    name, dropped = f"i{axis}", F.array(*[F.lit(k).cast("long") for k in gone])
    kept = a.cells.where(~F.array_contains(dropped, F.col(name))) if gone else a.cells
    if gone:
        kept = kept.withColumn(name, F.col(name) - F.size(F.filter(dropped, lambda k: k < F.col(name))))
    return NdArray(kept, tuple(d - len(gone) if k == axis else d for k, d in enumerate(a.shape)))


# --- indexing ------------------------------------------------------------------


def _index_table(spark, index, n: int, mode: str) -> tuple[DataFrame, int]:
    """Rows (p, j): result place and source place."""
    table = index.cells.select(F.col("i0").alias("p"), F.col("v").cast("long").alias("j")) if isinstance(index, NdArray) else spark.createDataFrame([(p, int(j)) for p, j in enumerate(index)], "p bigint, j bigint")
    size = index.size if isinstance(index, NdArray) else len(index)
    j = F.col("j")
    if mode == "wrap":
        j = F.pmod(j, F.lit(n))
    elif mode == "clip":
        j = F.greatest(F.least(j, F.lit(n - 1)), F.lit(0))
    else:
        j = F.when((j < -n) | (j >= n), F.raise_error(F.lit(f"index out of bounds for axis with size {n}")).cast("long")).when(j < 0, j + n).otherwise(j)
    return table.withColumn("j", j), size


def take(a: NdArray, index, axis: int | None = None, mode: str = "raise") -> NdArray:
    """Gather along an axis: an equality join with the table of indices."""
    if axis is None:
        a, axis = ravel(a), 0
    axis = a.axis(axis)
    table, size = _index_table(a.spark, index, a.shape[axis], mode)
    joined = a.cells.withColumnRenamed(f"i{axis}", "j").join(table, "j").withColumnRenamed("p", f"i{axis}")
    return NdArray(joined.select(*a.axes, "v"), tuple(size if k == axis else d for k, d in enumerate(a.shape)))


def put(a: NdArray, index, values: NdArray | Sequence, mode: str = "raise") -> NdArray:
    """Scatter to flat places; values cycle, the last write wins."""
    table, _ = _index_table(a.spark, index, a.size, mode)
    values = values if isinstance(values, NdArray) else array(a.spark, list(values))
    source = values.cells.select(F.col("i0").alias("m"), F.col("v").cast(a.dtype).alias("w"))
    writes = table.withColumn("m", F.pmod("p", F.lit(values.size))).join(source, "m").groupBy("j").agg(F.max(F.struct("p", "w"))["w"].alias("w"), F.lit(True).alias("_hit"))
    flat = ravel(a)
    done = flat.cells.join(writes, F.col("i0") == F.col("j"), "left").select("i0", F.when(F.col("_hit"), F.col("w")).otherwise(F.col("v")).alias("v"))
    return reshape(NdArray(done, flat.shape), a.shape)


def take_along_axis(a: NdArray, index: NdArray, axis: int = -1) -> NdArray:
    axis = a.axis(axis)
    name, n = f"i{axis}", a.shape[axis]
    wanted = index.cells.withColumn("j", F.when(F.col("v") < 0, F.col("v") + n).otherwise(F.col("v")).cast("long")).drop("v")
    lanes = [x for x in a.axes if x != name]
    source = a.cells.withColumnRenamed(name, "j")
    return NdArray(wanted.join(source, [*lanes, "j"]).select(*a.axes, "v"), index.shape)


def put_along_axis(a: NdArray, index: NdArray, values: NdArray, axis: int = -1) -> NdArray:
    name = f"i{a.axis(axis)}"
    lanes = [x for x in a.axes if x != name]
    source = values.cells.withColumnRenamed("v", "w")
    writes = index.cells.join(source, a.axes).select(*lanes, F.col("v").cast("long").alias("j"), F.col(name).alias("p"), "w")
    last = writes.groupBy(*lanes, "j").agg(F.max(F.struct("p", "w"))["w"].alias("w"), F.lit(True).alias("_hit")).withColumnRenamed("j", name)
    return NdArray(a.cells.join(last, a.axes, "left").select(*a.axes, F.when(F.col("_hit"), F.col("w").cast(a.dtype)).otherwise(F.col("v")).alias("v")), a.shape)


def compress(condition: Sequence[bool], a: NdArray, axis: int | None = None) -> NdArray:
    return take(a, [k for k, c in enumerate(condition) if c], axis)


def extract(condition: NdArray, a: NdArray) -> NdArray:
    """Values where the condition holds, in row order."""
    both = ravel(a).cells.join(ravel(condition).cells.withColumnRenamed("v", "c"), "i0").where(F.col("c").cast("boolean"))
    placed = dense_rank_positions(both, [F.col("i0")])
    return NdArray(placed.select(F.col("pos").alias("i0"), "v"), (both.count(),))


def place(a: NdArray, condition: NdArray, value) -> NdArray:
    return a.zip(condition, lambda v, c: F.when(c.cast("boolean"), F.lit(value)).otherwise(v))


copyto = place


def where(condition: NdArray, x: NdArray, y: NdArray) -> NdArray:
    condition, x, y = broadcast_arrays(condition, x, y)
    return condition.zip(x, lambda c, v: F.struct(c.cast("boolean").alias("c"), v.alias("v"))).zip(y, lambda s, w: F.when(s["c"], s["v"]).otherwise(w))


def nonzero(a: NdArray) -> DataFrame:
    """Coordinates of the cells that aren't zero."""
    return a.cells.where(F.col("v").cast("double") != 0).select(*a.axes)


argwhere = nonzero


def flatnonzero(a: NdArray) -> DataFrame:
    return nonzero(ravel(a))


def getitem(a: NdArray, key) -> NdArray:
    """Basic indexing (integers, slices, ellipsis, None), or one list, array or boolean array of indices."""
    if isinstance(key, NdArray) and key.dtype == "boolean":
        return extract(key, a)
    key = key if isinstance(key, tuple) else (key,)
    if Ellipsis in key:
        at = key.index(Ellipsis)
        used = sum(k is not None for k in key) - 1
        key = key[:at] + (slice(None),) * (a.ndim - used) + key[at + 1 :]
    out, axis = a, 0
    for k in key:
        if k is None:
            out = expand_dims(out, axis)
            axis += 1
        elif isinstance(k, int):
            out = take_index(out, k, axis)
        elif isinstance(k, slice):
            low, high, step = k.indices(out.shape[axis])
            n = len(range(low, high, step))
            name = f"i{axis}"
            inside = ((F.col(name) - low) % step == 0) & F.floor((F.col(name) - low) / step).between(0, n - 1)
            out = NdArray(out.cells.where(inside).withColumn(name, F.floor((F.col(name) - low) / step).cast("long")), tuple(n if d == axis else s for d, s in enumerate(out.shape)))
            axis += 1
        else:
            out = take(out, k, axis)
            axis += 1
    return out


def ravel_multi_index(columns: Sequence[str], dims: Sequence[int], mode: str = "raise") -> Column:
    out = F.lit(0).cast("long")
    for name, d, step in zip(columns, dims, strides(dims)):
        c = F.col(name)
        c = F.pmod(c, F.lit(d)) if mode == "wrap" else F.greatest(F.least(c, F.lit(d - 1)), F.lit(0)) if mode == "clip" else F.when((c < 0) | (c >= d), F.raise_error(F.lit("invalid entry in coordinates array")).cast("long")).otherwise(c)
        out = out + c * step
    return out


def unravel_index(lin: Column, shape: Sequence[int]) -> list[Column]:
    return unlinear(lin, shape)
