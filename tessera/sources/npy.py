"""Array files: a Spark data source for .npy and .npz, raw buffers, and the writers.

Files are opened by URI through Arrow's file systems, so the driver and the executors
see the same store. Reading splits a file into ranges of cells; a range is one read.
An array is written as a directory of part files, each a valid .npy of a range of
cells in row order, or, streamed through the driver, as a single file.
"""

from __future__ import annotations

import ast
import math
import struct
import uuid
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.operators.array import NdArray, axis_names, unlinear

CELLS = 1 << 20
#: Fixed value: the first bytes of the format.
MAGIC = b"\x93NUMPY"


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def spark_type(dtype: np.dtype) -> str:
    """Unsigned types take the next wider signed one; uint64 a decimal; complex a struct; half a float."""
    kind, size = dtype.kind, dtype.itemsize
    if kind == "b":
        return "boolean"
    if kind == "i":
        return {1: "tinyint", 2: "smallint", 4: "int", 8: "bigint"}[size]
    if kind == "u":
        return {1: "smallint", 2: "int", 4: "bigint", 8: "decimal(20,0)"}[size]
    if kind == "f":
        return "double" if size == 8 else "float"
    if kind == "c":
        return "struct<re:double,im:double>"
    if kind == "U":
        return "string"
    if kind == "S":
        return "binary"
    raise ValueError(f"arrays of {dtype} can't be read; object arrays never are")


def parse_header(head: bytes) -> tuple[np.dtype, bool, tuple[int, ...], int]:
    """dtype, Fortran order, shape and the data's offset."""
    if head[:6] != MAGIC:
        raise ValueError("not an .npy file")
    wide = head[6] > 1
    (length,) = struct.unpack_from("<I" if wide else "<H", head, 8)
    start = 12 if wide else 10
    told = ast.literal_eval(head[start : start + length].decode("latin-1" if head[6] < 3 else "utf-8"))
    dtype = np.dtype(told["descr"])
    if dtype.hasobject:
        raise ValueError("Object arrays cannot be loaded when allow_pickle=False")
    return dtype, told["fortran_order"], tuple(told["shape"]), start + length


def make_header(dtype: np.dtype, shape: tuple[int, ...]) -> bytes:
    text = f"{{'descr': {dtype.str!r}, 'fortran_order': False, 'shape': {shape!r}, }}"
    pad = -(len(MAGIC) + 4 + len(text) + 1) % 64
    body = (text + " " * pad + "\n").encode("latin-1")
    return MAGIC + b"\x01\x00" + struct.pack("<H", len(body)) + body


class _Where:
    """Where an array's cells lie: in a file, in a stored or deflated member of an .npz, or in a raw file."""

    def __init__(self, options: dict):
        self.path, self.member = options["path"], options.get("member")
        files, name = opened(self.path)
        self.packed = None
        if "dtype" in options:
            self.dtype, self.fortran = np.dtype(options["dtype"]), False
            self.offset = int(options.get("offset", 0))
            count = int(options.get("count", -1))
            size = files.get_file_info(name).size - self.offset
            self.shape = (size // self.dtype.itemsize if count < 0 else count,)
            return
        with files.open_input_file(name) as file:
            if self.member is None:
                self.dtype, self.fortran, self.shape, self.offset = parse_header(file.read(min(file.size(), 1 << 16)))
                return
            with zipfile.ZipFile(file) as archive, archive.open(f"{self.member}.npy") as inside:
                self.dtype, self.fortran, self.shape, self.offset = parse_header(inside.read(1 << 16))
                self.packed = f"{self.member}.npy"

    def read(self, low: int, high: int) -> np.ndarray:
        files, name = opened(self.path)
        start, size = self.offset + low * self.dtype.itemsize, (high - low) * self.dtype.itemsize
        with files.open_input_file(name) as file:
            if self.packed is None:
                return np.frombuffer(file.read_at(size, start), self.dtype)
            with zipfile.ZipFile(file) as archive, archive.open(self.packed) as inside:
                inside.seek(start)
                return np.frombuffer(inside.read(size), self.dtype)


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.where, self.each = _Where(options), int(options.get("cells", CELLS))

    def partitions(self):
        n = math.prod(self.where.shape)
        return [_Range(i, min(n, i + self.each)) for i in range(0, max(n, 1), self.each)]

    def read(self, partition: _Range):
        values = self.where.read(partition.low, partition.high)
        places = np.unravel_index(np.arange(partition.low, partition.low + len(values)), self.where.shape, order="F" if self.where.fortran else "C") if self.where.shape else ()
        kind = self.where.dtype.kind
        native = values.astype(values.dtype.newbyteorder("="))
        if kind == "c":
            column = pa.StructArray.from_arrays([pa.array(native.real.astype(float)), pa.array(native.imag.astype(float))], ["re", "im"])
        elif kind == "u" and native.dtype.itemsize == 8:
            import decimal

            column = pa.array([decimal.Decimal(int(v)) for v in native], pa.decimal128(20, 0))
        elif kind == "u":
            column = pa.array(native.astype({1: np.int16, 2: np.int32, 4: np.int64}[native.dtype.itemsize]))
        elif kind == "f" and native.dtype.itemsize == 2:
            column = pa.array(native.astype(np.float32))
        else:
            column = pa.array(native.tolist() if kind in "US" else native)
        yield pa.RecordBatch.from_arrays([*[pa.array(p.astype(np.int64)) for p in places], column], [*axis_names(len(places)), "v"])


class NpyDataSource(DataSource):
    """spark.read.format("npy").load(path); options: member (of an .npz), dtype, offset and count (raw), cells (of a partition)."""

    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        where = _Where(self.options)
        return ", ".join([*(f"{n} bigint" for n in axis_names(len(where.shape))), f"v {spark_type(where.dtype)}"])

    def reader(self, schema):
        return _Reader(self.options)


def load(spark: SparkSession, path: str, **options) -> NdArray:
    """An array of a .npy file, an .npz member (member=…) or a raw file (dtype=…)."""
    spark.dataSource.register(NpyDataSource)
    options = {k: str(v) for k, v in options.items()}
    shape = _Where({"path": path, **options}).shape
    return NdArray(spark.read.format("npy").options(**options).load(path), shape)


def frombuffer(spark: SparkSession, path: str, dtype: str = "float64", count: int = -1, offset: int = 0) -> NdArray:
    return load(spark, path, dtype=np.dtype(dtype).str, count=count, offset=offset)


def names(path: str) -> list[str]:
    """The arrays of an .npz."""
    files, name = opened(path)
    with files.open_input_file(name) as file, zipfile.ZipFile(file) as archive:
        return [n.removesuffix(".npy") for n in archive.namelist()]


def _numpy_type(kind: str) -> np.dtype:
    return np.dtype({"boolean": "?", "tinyint": "<i1", "smallint": "<i2", "int": "<i4", "bigint": "<i8", "float": "<f4", "double": "<f8"}.get(kind) or (_ for _ in ()).throw(ValueError(f"no .npy type for {kind}")))


def save_parts(a: NdArray, folder: str, cells: int = CELLS) -> int:
    """Write a directory of .npy files, one for each range of cells; every task writes its own. The number of files."""
    dtype, size, each = _numpy_type(a.dtype), a.size, cells
    count = max(1, -(-size // each))
    placed = a.cells.select(a.lin().alias("lin"), "v").withColumn("part", F.floor(F.col("lin") / each).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        n = min(each, size - part * each)
        values = np.zeros(n, dtype)
        values[table.column("lin").to_numpy() - part * each] = table.column("v").to_numpy()
        files, name = opened(folder)
        files.create_dir(name, recursive=True)
        target = f"{name}/part-{part:05d}.npy"
        draft = f"{target}.{uuid.uuid4().hex}"  # attempts never share a file, and a reader never sees half of one
        with files.open_output_stream(draft) as out:
            out.write(make_header(dtype, (n,)) + values.tobytes())
        files.move(draft, target)
        return pa.table({"part": pa.array([part], pa.int32())})

    placed.groupBy("part").applyInArrow(run, "part int").count()
    return count


def _stream(a: NdArray, out) -> None:
    dtype = _numpy_type(a.dtype)
    out.write(make_header(dtype, a.shape))
    held = []
    for row in a.cells.select(a.lin().alias("lin"), "v").orderBy("lin").select("v").toLocalIterator():
        held.append(row[0])
        if len(held) == 1 << 16:
            out.write(np.array(held, dtype).tobytes())
            held = []
    out.write(np.array(held, dtype).tobytes())


def save(a: NdArray, path: str) -> None:
    """A single .npy file, streamed through the driver in order; memory stays that of a partition."""
    files, name = opened(path)
    with files.open_output_stream(name) as out:
        _stream(a, out)


def savez(path: str, compressed: bool = False, **arrays: NdArray) -> None:
    files, name = opened(path)
    with files.open_output_stream(name) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if compressed else zipfile.ZIP_STORED) as archive:
        for key, a in arrays.items():
            with archive.open(f"{key}.npy", "w", force_zip64=True) as member:
                _stream(a, member)


def savez_compressed(path: str, **arrays: NdArray) -> None:
    savez(path, True, **arrays)


def memmap(spark: SparkSession, path: str, dtype: str, shape: tuple[int, ...], offset: int = 0) -> NdArray:
    """A raw file as an array of a shape; read only, as relations don't change."""
    flat = frombuffer(spark, path, dtype, math.prod(shape), offset)
    return NdArray(flat.cells.select(*unlinear(F.col("i0"), shape), "v"), tuple(shape))
