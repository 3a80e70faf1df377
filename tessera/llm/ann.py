"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are lifted by one component so that the largest inner product is the least
Euclidean distance. A table hashes a vector to the cell that several random Gaussian
projections, cut into steps, fall in. A query visits in each table its own cell and
perturbed cells, in the order of the estimated probability that a near neighbour lies
there, until the visited cells' probabilities reach the table's target; the candidates
of all tables are merged and ranked by exact inner products in double precision. How far
a near neighbour is, each query estimates from its own distances to a sample, so dense
groups of vectors don't set the depth of the others' search. A query whose k-th found
score is below its estimate is searched again through all parts. A cell is cut by fewer
projections if most sampled queries could not reach the target in PROBES cells; a query
that still can't visits none and is searched through all parts at once.

Cells are dealt out to parts of bounded size, and a cell that holds a good part of one
(a group of similar vectors) is cut into slices. A part holds its vectors in memory, each
once, and reads its queries as a stream; a query comes once to each part that it probes. Equal
vectors are one entry with the smallest ids that any query can need, so a vector's
copies don't fill a cell, and nothing is lost.

Defined results: vectors that are null, empty or zero or hold null or non-finite
components, or whose id is null, take no part; a query's candidates are the vectors of its
own length (hashes serve the most frequent length, others are searched exactly); a query
gets all its candidates if there are fewer than k; queries that the probes leave with fewer
than k or below the estimate are searched again through all parts; rows that
repeat an id are one candidate; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import usable_vector, written

K = 20
#: The hash functions are fitted on so many vectors at most, those with the smallest hash of the id.
SAMPLE = 2_000
TABLES, RECALL, PROBES = 8, 0.97, 384
STEP = 1.6
PART_BYTES = 32 << 20
#: The most cells that are cut into slices; beyond, only larger ones are.
MOST_SLICED = 100_000
#: Scores of a block of queries at once, and the share of the entries (one in so many) from which all are computed.
PRODUCT, DENSE = 8 << 20, 8
_erf = np.frompyfunc(math.erf, 1, 1)


class Hashes:
    """The projections of all tables, the lifting, and the order of probes."""

    def __init__(self, sample: np.ndarray, longest: float, n: int, k: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.longest, dim = max(longest, 1e-300), sample.shape[1] + 1
        depth = max(3, round(0.42 * math.log2(max(n, 2))))
        self.a = rng.normal(0, 1, (TABLES, dim, depth))
        self.b = rng.random((TABLES, 1, depth))
        self.mix = rng.integers(1, 1 << 62, (TABLES, depth), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(1, 1 << 62, (TABLES, 1), dtype=np.uint64)
        self.sample, self.squares = sample, (sample * sample).sum(axis=1)
        # The sample's place of the k-th neighbour: three deviations over the number of nearer vectors that the sample holds.
        held = k * len(sample) / max(n, 1)
        self.place = min(k, math.ceil(held + 3 * math.sqrt(held)) + 1)
        near = self.near(sample[:200])
        near = near[near > 1e-6]
        self.width = STEP * (float(np.median(near)) if len(near) else 1.0)
        self.target = 1 - (1 - RECALL) ** (1 / TABLES)
        asked = sample[:200]
        while depth > 3 and np.mean([len(p) > 0 for p in self.probes(asked)]) < 0.9:
            depth -= 1
            self.a, self.b, self.mix = self.a[..., :depth], self.b[..., :depth], self.mix[:, :depth]

    def _lift(self, x: np.ndarray) -> np.ndarray:
        x = x / self.longest
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))], axis=1)

    @staticmethod
    def _aim(q: np.ndarray) -> np.ndarray:
        q = q / np.abs(q).max(axis=1, keepdims=True)
        return np.concatenate([q / np.sqrt((q * q).sum(axis=1, keepdims=True)), np.zeros((len(q), 1))], axis=1)

    def bars(self, q: np.ndarray) -> np.ndarray:
        """The score that each query's k-th neighbour should reach, from the sample without the query's own vector."""
        scores = q @ self.sample.T
        apart = self.squares + (q * q).sum(axis=1, keepdims=True)
        scores[apart - 2 * scores <= 1e-12 * apart] = -np.inf
        if scores.shape[1] < self.place:
            return np.full(len(q), -np.inf)
        return -np.partition(-scores, self.place - 1, axis=1)[:, self.place - 1]

    def near(self, q: np.ndarray) -> np.ndarray:
        """How far each query's k-th neighbour is; the longest possible distance if the sample doesn't tell."""
        with np.errstate(invalid="ignore"):
            aims = self.bars(q) / (np.sqrt((q * q).sum(axis=1)) * self.longest)
        return np.sqrt(np.maximum(0, 2 - 2 * np.maximum(aims, -1)))

    def _places(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("nd,tdk->tnk", x, self.a) / self.width + self.b

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector in each table, (n, TABLES)."""
        steps = np.floor(self._places(self._lift(x))).astype(np.int64).astype(np.uint64)
        return ((steps * self.mix[:, None]).sum(axis=2, dtype=np.uint64) + self.salt).T.view(np.int64)

    def probes(self, q: np.ndarray) -> list[np.ndarray]:
        """The cells that each query visits, of all tables; none if PROBES cells of a table can't reach its target."""
        places = self._places(self._aim(q))
        base = np.floor(places)
        offsets = np.arange(-2, 3)
        near = np.maximum(self.near(q), 1e-3 * self.width)[:, None, None]
        edges = (base[..., None] + np.arange(-2, 4) - places[..., None]) * self.width / (near * math.sqrt(2))
        chance = np.diff(_erf(edges).astype(np.float64), axis=-1) / 2
        out: list[list[np.ndarray]] = [[] for _ in q]
        reached = np.ones(len(q), bool)
        for t in range(TABLES):
            weight, code = np.ones((len(q), 1)), np.full((len(q), 1), self.salt[t, 0], np.uint64)
            for k in range(self.a.shape[2]):
                steps = (base[t, :, k, None] + offsets).astype(np.int64).astype(np.uint64) * self.mix[t, k]
                weight = (weight[:, :, None] * chance[t, :, None, k]).reshape(len(q), -1)
                code = (code[:, :, None] + steps[:, None]).reshape(len(q), -1)
                if weight.shape[1] > PROBES:  # a prefix of one of the best combinations is among the best prefixes
                    best = np.argpartition(-weight, PROBES, axis=1)[:, :PROBES]
                    weight, code = np.take_along_axis(weight, best, 1), np.take_along_axis(code, best, 1)
            order = np.argsort(-weight, axis=1, kind="stable")
            weight, code = np.take_along_axis(weight, order, 1), np.take_along_axis(code, order, 1)
            wanted = np.cumsum(weight, axis=1) - weight < self.target
            reached &= weight.sum(axis=1) >= self.target
            for i in range(len(q)):
                out[i].append(code[i, wanted[i]].view(np.int64))
        return [np.unique(np.concatenate(x)) if whole else np.empty(0, np.int64) for x, whole in zip(out, reached)]


#: A vector in a part: kind 0 an entry with its ids and the cells that hold it, kind 1 a query (id) with the cells it visits, null for all.
_ROW = "part bigint, kind int, id bigint, v binary, ids array<bigint>, cells array<bigint>"
_KINDS = {"part": pa.int64(), "kind": pa.int32(), "id": pa.int64(), "v": pa.binary(), "ids": pa.list_(pa.int64()), "cells": pa.list_(pa.int64())}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS.values())], list(_KINDS))


def _vectors(column) -> np.ndarray:
    rows = column.to_numpy(zero_copy_only=False)
    return np.stack(rows).astype(np.float64)


class Parts:
    """Which part each cell is in. A cell of many entries is cut into slices by the vectors' hashes, each in a part of its own."""

    def __init__(self, many: int, sliced: dict[int, int]):
        self.many = many
        self.cells = np.array(sorted(sliced), np.int64)
        self.slices = np.array([min(many, sliced[c]) for c in self.cells.tolist()], np.int64)

    def _slices(self, cells: np.ndarray) -> np.ndarray:
        if not len(self.cells):
            return np.ones(len(cells), np.int64)
        at = np.minimum(np.searchsorted(self.cells, cells), len(self.cells) - 1)
        return np.where(self.cells[at] == cells, self.slices[at], 1)

    @staticmethod
    def _grouped(cells: np.ndarray, where: np.ndarray) -> list[tuple[int, list[int]]]:
        order = np.argsort(where, kind="stable")
        cuts = np.flatnonzero(np.diff(where[order])) + 1
        return [(int(where[g[0]]), cells[g].tolist()) for g in np.split(order, cuts) if len(g)]

    def holding(self, cells: np.ndarray, vector: bytes) -> list[tuple[int, list[int]]]:
        """The parts that hold an entry, each with its cells there."""
        return self._grouped(cells, (cells % self.many + zlib.crc32(vector) % self._slices(cells)) % self.many)

    def visited(self, cells: np.ndarray) -> list[tuple[int, list[int]]]:
        """The parts that hold any slice of a query's cells, each with these cells."""
        slices = self._slices(cells)
        every = np.repeat(cells, slices)
        nth = np.arange(len(every)) - np.repeat(np.cumsum(slices) - slices, slices)
        return self._grouped(every, (every % self.many + nth) % self.many)


def _parts(entries: DataFrame, hashes, n: int, row_bytes: int) -> Parts:
    """Parts of about PART_BYTES; cells over an eighth of a part's rows are sliced (MOST_SLICED of them at most)."""
    many = max(8, math.ceil(n * TABLES * row_bytes / PART_BYTES))
    rows = max(1, PART_BYTES // row_bytes // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                cells = hashes.value.cells(_vectors(whole.column(0).slice(i, 1000)))
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel())], ["cell"])

    sizes = entries.select("v").mapInArrow(run, "cell bigint").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > max(rows, n * TABLES // MOST_SLICED)).collect()  # fewer than MOST_SLICED: the cells hold n * TABLES entries
    return Parts(many, {r["cell"]: math.ceil(r["n"] / rows) for r in large})


def _entries(entries: DataFrame, hashes, parts) -> DataFrame:
    """Each entry once in each part that holds one of its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch, rows = whole.slice(i, 1000), []
                x = _vectors(batch.column(0))
                for v, own, cells in zip(x, batch.column(1).to_pylist(), hashes.value.cells(x)):
                    vector = v.tobytes()
                    rows += [(p, 0, 0, vector, own, there) for p, there in parts.value.holding(cells, vector)]
                yield _batch(rows)

    return entries.select("v", "ids").mapInArrow(run, _ROW)


def _bars(queries: DataFrame, hashes) -> DataFrame:
    """Each query's bar of Hashes.bars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(hashes.value.bars(_vectors(batch.column(0))))], ["id", "bar"])

    return queries.select("v", "id").mapInArrow(run, "id bigint, bar double")


def _asked(queries: DataFrame, hashes, parts) -> DataFrame:
    """Each query once in each part that it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                batch, rows = whole.slice(i, 64), []
                q = _vectors(batch.column(0))
                for v, name, cells in zip(q, batch.column(1).to_pylist(), hashes.value.probes(q)):
                    vector = v.tobytes()
                    rows += [(p, 1, name, vector, None, there) for p, there in parts.value.visited(cells)]
                yield _batch(rows)

    return queries.select("v", "id").mapInArrow(run, _ROW)


def _exactly(entries: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Partial results of the queries over all entries of their length, which are dealt out to parts of bounded bytes."""
    sizes = entries.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("size", F.ceil(F.col("n") * 8 * F.col("size") / F.lit(PART_BYTES)).cast("int").alias("parts"))
    split = entries.select("v", "ids", F.size("v").alias("size")).join(sizes, "size").select("v", "ids", F.xxhash64("size", F.pmod(F.xxhash64("v"), F.col("parts"))).alias("part"))
    every = queries.select("v", "id", F.size("v").alias("size")).join(sizes, "size")
    every = every.select("v", "id", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1)).alias("at")).select("v", "id", F.xxhash64("size", "at").alias("part"))

    def packed(kind: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for v, own, p in zip(*(c.to_pylist() for c in batch.columns)):
                    rows.append((p, kind, 0 if kind == 0 else own, np.array(v, np.float64).tobytes(), own if kind == 0 else None, None))
                    if len(rows) == 1000:
                        yield _batch(rows)
                        rows.clear()
            if rows:
                yield _batch(rows)

        rows: list[tuple] = []
        return run

    dealt = split.mapInArrow(packed(0), _ROW).union(every.mapInArrow(packed(1), _ROW))
    return _searched(dealt.repartition("part").sortWithinPartitions("part", "kind"), k).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def _best(x: np.ndarray, ids: list, rows: np.ndarray, rough: np.ndarray, q: np.ndarray, own: int, k: int) -> list[tuple[float, int]]:
    """The k nearest (score, id) of the entries in rows with these rough scores, ties to the smaller id, the query's own id left out."""
    if len(rows) > k + 1:
        bar = np.partition(rough, len(rows) - k - 1)[len(rows) - k - 1]  # one more: an entry may be the query's own alone
        rows = rows[rough >= bar - 1e-9 * (1 + abs(bar))]
    exact = (x[rows] * q).sum(axis=1)
    found = sorted((-float(s), i) for s, r in zip(exact, rows) for i in ids[r] if i != own)
    return [(-s, i) for s, i in found[:k]]


def _searched(dealt: DataFrame, k: int) -> DataFrame:
    """Partial results of each part: rows come sorted, a part's entries before its queries.

    Queries are taken in blocks. If a block's queries look at a good part of the entries, one matrix product
    gives all scores, which costs less than to gather each query's rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, vectors, names, where, x, held, block = None, [], [], {}, None, [], []

        def answered() -> None:
            if not block:
                return
            looked = sum(len(x) if rows is None else len(rows) for _, _, rows in block)
            scores = np.stack([q for _, q, _ in block]) @ x.T if looked * DENSE >= len(block) * len(x) else None
            for i, (own, q, rows) in enumerate(block):
                if rows is None:
                    rows = np.arange(len(x))
                rough = x[rows] @ q if scores is None else scores[i, rows]
                held.extend((own, other, s) for s, other in _best(x, names, rows, rough, q, own, k))
            block.clear()

        for batch in batches:
            for p, kind, name, v, ids, cells in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    answered()
                    part, vectors, names, where, x = p, [], [], {}, None
                if kind == 0:
                    for c in cells or ():
                        where.setdefault(c, []).append(len(vectors))
                    vectors.append(np.frombuffer(v))
                    names.append(ids)
                    continue
                if not vectors:
                    continue
                if x is None:
                    x, vectors = np.stack(vectors), [True]
                    where = {c: np.array(r) for c, r in where.items()}
                rows = None
                if cells is not None:
                    found = [where[c] for c in cells if c in where]
                    if not found:
                        continue
                    if len(found) > 1:  # an entry is in a cell of each table
                        mark = np.zeros(len(x), bool)
                        mark[np.concatenate(found)] = True
                        found = [np.flatnonzero(mark)]
                    rows = found[0]
                block.append((name, np.frombuffer(v), rows))
                if len(block) == 64 or len(block) * len(x) >= PRODUCT:
                    answered()
                if len(held) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], ["query_id", "vec_id", "score"])
                    held.clear()
        answered()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], ["query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, exact: bool = False) -> DataFrame:
    """For each row that the condition names its k nearest others by inner product: query_id, rank, vec_id, score.

    exact: no hashing, every query is compared with all vectors.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    usable = vectors.where(F.col(id_col).isNotNull() & usable_vector(F.col(vector_col)))
    slim = usable.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"))
    lengths = slim.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if lengths is None:
        return empty
    dim = lengths["size"]
    slim, _ = written(slim.dropDuplicates(["id", "v"]), "vectors")
    # Of equal vectors no query needs more than the k + 1 smallest ids.
    ranked = slim.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    entries, _ = written(ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "entries")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    asked = slim.where("asked").select("v", "id")

    def ranks(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    if exact:
        return ranks(_exactly(entries, asked, k))
    whole, wanted, other = entries, asked.where(F.size("v") == dim), asked.where(F.size("v") != dim)
    entries = entries.where(F.size("v") == dim)
    squares = F.aggregate("v", F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double"))
    n, longest = entries.agg(F.count(F.lit(1)), F.sqrt(F.max(squares))).first()
    first = F.col("ids")[0]
    sample = entries.orderBy(F.xxhash64(first), first).limit(SAMPLE).select("v").collect()
    hashes = spark.sparkContext.broadcast(Hashes(np.array([r.v for r in sample], np.float64), longest, n, k))  # bounded: the sample and the projections
    parts = spark.sparkContext.broadcast(_parts(entries, hashes, n, 8 * dim))  # bounded by MOST_SLICED
    dealt = _entries(entries, hashes, parts).union(_asked(wanted, hashes, parts)).repartition(parts.value.many, "part").sortWithinPartitions("part", "kind")
    found, _ = written(_searched(dealt, k).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "found")
    reached = found.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("query_id", F.col("score").alias("kth"))
    bars = _bars(wanted, hashes).groupBy("id").agg(F.max("bar").alias("bar"))
    slack = 1e-9 * (1 + F.abs("bar"))  # the bar's scores are summed in another order
    done = reached.join(bars, F.col("id") == F.col("query_id")).where((F.col("bar") == float("-inf")) | (F.col("kth") >= F.col("bar") - slack)).select("query_id")
    short = wanted.join(done, F.col("id") == F.col("query_id"), "left_anti")
    short, _ = written(short.unionByName(other), "short")
    if not short.isEmpty():
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(_exactly(whole, short, k))
    return ranks(found)


def op7_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
