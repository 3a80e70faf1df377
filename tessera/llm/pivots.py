"""Embedding near-dedup by a pivot-permutation index.

Each distinct vector is described by the ordered list of its nearest reference points
(pivots, a bounded sample of the vectors). Inverted lists hold for every pivot the
vectors that name it; two vectors of a list are candidates if they share enough
pivots, and candidates are verified by their cosine in double precision. A pair is
judged in one list only, that of the least pivot it shares. A list longer than a tile
is cut into tiles and every pair of its tiles is a group of its own, so no group grows
with the list and no pair is lost. Two links' ends that share fewer pivots are missed;
exact=True compares all vectors, tile by tile, and misses nothing.

A group returns for each vector the number of links found and the least vector of its
connected part of the group, never the pairs: the output is linear in the lists, and
components of these edges are those of all links.

Defined results: a vector that is null, empty or zero or holds null or non-finite
components, or whose id is null, links with nothing; vectors of different lengths
link with nothing of another length; equal vectors are one class, each row of it
counts as a link of the others; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import usable_vector, written
from tessera.llm.components import components

COSINE = 0.9
#: Pivots a vector names, and how many of them a candidate pair must share.
NAMED, SHARED = 12, 2
#: The most bytes of pivots (a broadcast; at 64 dimensions enough for 4e9 vectors) and the rows of a tile.
PIVOT_BYTES, TILE = 128 << 20, 2_048


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = column.to_numpy(zero_copy_only=False)
    return np.stack(rows).astype(np.float64) if len(rows) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first, so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _apart(units: np.ndarray, most: float = 0.8) -> np.ndarray:
    """Of unit vectors in order, those that are not within a cosine of most of one taken before: among near copies
    every pivot would be as near as the next, and their order would tell nothing."""
    taken = np.zeros((0, units.shape[1]))
    for i in range(0, len(units), 256):
        block = units[i : i + 256]
        block = block[(block @ taken.T < most).all(axis=1)]
        within, keep = block @ block.T, []
        for j in range(len(block)):
            if (within[j, keep] < most).all():
                keep.append(j)
        taken = np.concatenate([taken, block[keep]])
    return taken


def _named(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds the ordered pivots of each class."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)  # bounded by PIVOT_BYTES

    def run(batches):
        for batch in batches:
            out = np.empty(batch.num_rows, object)
            lengths = np.array([len(v) for v in batch.column(1).to_numpy(zero_copy_only=False)])
            for size in np.unique(lengths):
                rows, own = np.flatnonzero(lengths == size), shared.value.get(int(size))
                for i in range(0, len(rows), 2048):
                    part = rows[i : i + 2048]
                    if own is None:
                        near = np.zeros((len(part), 1), np.int32)
                    else:
                        near = np.argsort(-(_unit(_matrix(batch.column(1).take(pa.array(part)))) @ own.T), axis=1, kind="stable")[:, :NAMED]
                    for r, n in zip(part, near):
                        out[r] = n.astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(out), pa.list_(pa.int32()))], [*batch.schema.names, "pivots"])

    return classes.mapInArrow(run, f"class bigint, v {classes.schema['v'].dataType.simpleString()}, copies bigint, pivots array<int>")


def _group(table: pa.Table, least: float, shared: int) -> pa.Table:
    """Links within a tile or between two tiles of a pivot's list."""
    pivot, left, right = (table.column(c)[0].as_py() for c in ("pivot", "left", "right"))
    tile = table.column("tile").to_numpy()
    name = table.column("class").to_numpy()
    copies = table.column("copies").to_numpy()
    x = _unit(_matrix(table.column("v").combine_chunks()))
    flat = table.column("pivots").combine_chunks()
    counts = np.diff(flat.offsets.to_numpy())
    named = np.full((len(name), counts.max()), -1, np.int32)
    named[np.arange(named.shape[1]) < counts[:, None]] = flat.values.to_numpy()
    a = np.flatnonzero(tile == left)
    b = a if left == right else np.flatnonzero(tile == right)
    first, second = [], []
    for i in range(0, len(a), 512):
        rows = a[i : i + 512]
        # The cosines cost less than the counts of shared pivots, so these are taken of pairs that are near enough.
        near = x[rows] @ x[b].T >= least
        if left == right:
            near &= rows[:, None] < b[None, :]
        p, q = np.nonzero(near)
        p, q = rows[p], b[q]
        for k in range(0, len(p), 1 << 16):
            one, other = p[k : k + (1 << 16)], q[k : k + (1 << 16)]
            both = (named[one][:, :, None] == named[other][:, None, :]).any(axis=2) & (named[one] >= 0)
            earlier = (both & (named[one] < pivot)).any(axis=1)
            keep = ~earlier & (both.sum(axis=1) >= np.minimum(shared, np.minimum(counts[one], counts[other])))
            first.append(one[keep])
            second.append(other[keep])
    p, q = (np.concatenate(s) if s else np.zeros(0, np.int64) for s in (first, second))
    links = np.bincount(p, weights=copies[q], minlength=len(name)) + np.bincount(q, weights=copies[p], minlength=len(name))
    root, before = name.copy(), None
    while before is None or (root != before).any():
        before = root.copy()
        np.minimum.at(root, p, before[q])
        np.minimum.at(root, q, before[p])
    some = np.flatnonzero(links)
    return pa.table([pa.array(name[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], names=["class", "links", "root"])


def near_copies(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = COSINE, shared: int = SHARED, tile: int = TILE, exact: bool = False
) -> DataFrame:
    """One row per vector: its id, n_links, component_id (the least id reachable) and kept (it is its component's least).

    exact: all vectors are in one list, so every pair is compared, at a cost that grows with the square of the table.
    """
    spark = vectors.sparkSession
    fit = F.col(id_col).isNotNull() & usable_vector(F.col(vector_col))
    slim = vectors.select(F.col(id_col), F.when(fit, F.col(vector_col)).alias("v"))
    classes, _ = written(slim.where("v IS NOT NULL").groupBy("v").agg(F.min(id_col).cast("bigint").alias("class"), F.count(F.lit(1)).alias("copies")).select("class", "v", "copies"), "classes")
    n, widest = classes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    many = min(max(16, PIVOT_BYTES // (8 * widest)), max(16, math.ceil(4 * math.sqrt(n))))
    chosen: dict[int, list] = {}
    for row in [] if exact else classes.orderBy(F.xxhash64("class"), "class").limit(many).select("v").collect():
        chosen.setdefault(len(row.v), []).append(row.v)
    pivots = {size: _apart(_unit(np.array(rows, np.float64))) for size, rows in chosen.items()}
    named, _ = written(_named(classes, pivots), "named")
    # Vectors of another length never meet: the length is part of the list's name.
    listed = named.select("class", "v", "copies", "pivots", F.size("v").alias("size"), F.explode("pivots").alias("pivot"))
    sizes = named.select(F.size("v").alias("size"), F.explode("pivots").alias("pivot")).groupBy("size", "pivot").count()
    sizes = sizes.select("size", "pivot", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    tiles = listed.join(sizes, ["size", "pivot"]).withColumn("tile", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int"))
    pairs = tiles.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")).select(
        "size", "pivot", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"), "tile", "class", "v", "copies", "pivots"
    )
    found = pairs.groupBy("size", "pivot", "left", "right").applyInArrow(lambda t: _group(t, least, shared), "class bigint, links bigint, root bigint")
    found, _ = written(found, "links")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    labels = components(found.select("class", "root"), "class", "root", "class", "component")
    told = classes.join(links, "class", "left").join(labels, "class", "left").select(
        "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "class").alias("component")
    )
    kind = vectors.schema[id_col].dataType
    return slim.join(told, "v", "left").select(
        id_col, F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce(F.col("component").cast(kind), F.col(id_col)).alias("component_id")
    ).withColumn("kept", F.col(id_col) == F.col("component_id"))


def op1_pivots(spark, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
