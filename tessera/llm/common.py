"""What the operators of this subpackage share: the shared folder, work tables, valid vectors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where it is unset and the master is local (tests, a single machine) a
    temporary folder takes its place.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        context.setCheckpointDir(base)
    return base.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}/{label}"


def written(frame: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write a work table to the shared folder and read it back: cuts the lineage durably."""
    path = work_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a work table that no later plan reads."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where.getParent(), True)


def widened(frame: DataFrame, kept: list[str], more: dict) -> StructType:
    """The schema of some columns of a table and of new ones."""
    return StructType([*(frame.schema[c] for c in kept), *(StructField(c, t) for c, t in more.items())])


def mapped(frame: DataFrame, run, schema: StructType) -> DataFrame:
    """mapInArrow, which fails for names with dots: run sees the columns by their places."""
    return numbered(frame)[0].mapInArrow(run, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the fold of a document. A null id is in no fold's remainder (null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def usable_vector(vector: Column) -> Column:
    """True for a vector that is neither null, empty nor zero and holds only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def column(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(frame: DataFrame, name: str) -> str:
    """A name like this that no column of the table has, in upper or lower case."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(frame: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with its columns named c0, c1, ..., and the new name of each: what an operator adds then clashes with nothing."""
    names = [f"c{i}" for i in range(len(frame.columns))]
    return frame.toDF(*names), dict(zip(frame.columns, names))


def by_size(batches, column: int, limit: int = 4 << 20):
    """Cut Arrow batches into slices of about limit bytes of a text column (one row at least), so that what is made of a slice stays small."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)
