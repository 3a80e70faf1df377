"""SimHash near-dedup by deletion-variant signatures.

A 64-bit fingerprint is cut into few segments, so few that of two fingerprints
within the radius at least one segment differs by at most one bit
(``segments = radius // 2 + 1``). Each segment is indexed once for each of its
bits with that bit wiped out; two fingerprints whose segment differs by at most
one bit meet in a variant. An equality join on the variants and a check of the
Hamming distance give every link once. Exact copies of a fingerprint are one node.

Where links must reach a Jaccard similarity, fingerprints alone don't tell: a pair of
similarity 0.8 differs in about ten bits. Equal bands of min-hashes of the same shingles
are candidates too (a pair of 0.8 shares one with probability 0.9996) if a bit of each
min-hash differs at no more than 22 of 100 places (0.9999), and every candidate's
similarity is computed from the texts. In a bucket of equal bands or equal fingerprints
all are first compared with the least node; pairs whose components still differ then are
compared each. Equal texts are one node.

All joins are sort-merge joins by hint: both sides grow with the input, and the planner
underrates them (the variants by a factor of 64, work tables by their compression), so
that it would have the driver build and broadcast them.

Defined results: a null text counts as empty; a text without words has
fingerprint zero; fewer words than the shingle width make one shingle of the
whole sequence; a null id keeps its row and takes the least non-null id of its
component, or null; repeated rows are kept; an empty table gives no rows. Columns
beside the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_size, column, fresh, written
from tessera.llm.components import components

BITS = 64
SEED = 42
#: Bands of min-hashes and min-hashes a band.
BANDS, ROWS = 20, 5
#: Candidates differ in at most so many of the 100 min-hashes' bits: a pair of similarity 0.8 differs in 10 (deviation 3).
SKETCH = 22
_random = np.random.default_rng(SEED)
_OWN = (np.arange(128) < BANDS * ROWS).astype(np.uint8)
_FLIP, _TURN, _MIX = (_random.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (BANDS * ROWS, BANDS * ROWS, (BANDS, ROWS)))


def _hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """The hashes of a text's word shingles, in blocks."""
    words = (text or "").encode().lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    step = 1 << 15
    for i in range(0, len(starts), step):
        pieces = [joined[a:b] for a, b in zip(starts[i : i + step].tolist(), ends[i : i + step].tolist())]
        yield np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(pieces))


def _signature(text: str | None, width: int, banded: bool) -> tuple[int, list[int] | None, tuple[int, int]]:
    """The SimHash of a text's word shingles, as an unsigned integer, the keys of its bands (none without words) and a bit of each min-hash."""
    total, count, least = np.zeros(BITS, np.int64), 0, None
    for hashes in _hashes(text, width):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int32)
        count += len(hashes)
        for i in range(0, len(hashes) if banded else 0, 512):
            low = ((hashes[i : i + 512, None] ^ _FLIP) * _TURN).min(axis=0)
            least = low if least is None else np.minimum(least, low)
    keys, sketch = None, (0, 0)
    if least is not None:
        keys = ((least.reshape(BANDS, ROWS) >> np.uint64(1)) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()
        sketch = tuple(np.packbits(np.resize((least >> np.uint64(7)) & np.uint64(1), 128).astype(np.uint8) * _OWN).view(np.int64).tolist())
    return int.from_bytes(np.packbits(total * 2 > count).tobytes(), "big"), keys, sketch


def fingerprint(text: str | None, width: int) -> int:
    """The SimHash of a text's word shingles, as an unsigned integer."""
    return _signature(text, width, False)[0]


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int, banded: bool = False) -> DataFrame:
    """Columns (id_col, fp): the fingerprint as a signed long; with banded also bands, the keys of the bands of min-hashes, their bits s0 and s1, and the text's node."""
    names = [id_col, "fp", "bands", "s0", "s1", "node"] if banded else [id_col, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 1):
            found = [_signature(t.as_py(), width, banded) for t in batch.column(1)]
            columns = [batch.column(0), pa.array(np.fromiter((f for f, _, _ in found), np.uint64, len(found)).view(np.int64))]
            if banded:
                columns += [pa.array([keys for _, keys, _ in found], pa.list_(pa.int64())), *(pa.array([s[i] for *_, s in found], pa.int64()) for i in (0, 1)), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(column(id_col), column(text_col), *([_node(text_col)] if banded else []))
    return source.mapInArrow(run, f"`{id_col}` {kind}, fp bigint" + (", bands array<bigint>, s0 bigint, s1 bigint, node bigint" if banded else ""))


def _node(text_col: str) -> Column:
    """What equal texts have in common."""
    return F.xxhash64(F.coalesce(column(text_col), F.lit("")))


def _segments(count: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    edges = [round(BITS * i / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """Pairs (left, right) of distinct fingerprints at most radius bits apart, each once.

    Two segments can meet in many variants; only the first that a pair shares counts,
    which its XOR tells: the first segment with at most one bit set, at that bit or,
    if it has none, at the segment's lowest.
    """
    cut = _segments(radius // 2 + 1)
    rows, first, earlier = [], [], []
    for low, size in cut:
        whole = ((1 << size) - 1) << low
        before = " AND ".join(f"bit_count((l.fp ^ r.fp) & {_signed(m)}L) > 1" for m in earlier)
        first.append(f"WHEN l.bit < {low + size} THEN ((l.fp ^ r.fp) & {_signed(whole)}L <> 0 OR l.bit = {low})" + (f" AND {before}" if before else ""))
        earlier.append(whole)
        rows += [f"named_struct('bit', {low + b}, 'mask', {_signed(whole & ~(1 << (low + b)))}L)" for b in range(size)]
    # Both sides need the same columns, so that one exchange serves both.
    variants = nodes.select("fp", F.explode(F.expr(f"array({', '.join(rows)})")).alias("v")).select(
        "fp", F.expr("v.bit").alias("bit"), F.expr("fp & v.mask").alias("wiped")
    )
    meets = f"l.bit = r.bit AND l.wiped = r.wiped AND l.fp < r.fp AND bit_count(l.fp ^ r.fp) <= {radius} AND CASE {' '.join(first)} END"
    return variants.alias("l").join(variants.hint("merge").alias("r"), F.expr(meets)).select(
        F.col("l.fp").alias("left"), F.col("r.fp").alias("right")
    )


def _shingles(text: str | None, width: int) -> set[bytes]:
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def _similar(pairs: DataFrame, docs: DataFrame, text_col: str, width: int, least: float) -> DataFrame:
    """Of pairs of nodes (texts), those whose shingle sets have a Jaccard similarity of least or more."""
    ends = pairs.select(F.col("left").alias("node")).union(pairs.select("right")).distinct()
    texts = docs.select(_node(text_col).alias("node"), F.coalesce(column(text_col), F.lit("")).alias("text")).join(ends.hint("merge"), "node", "left_semi").dropDuplicates(["node"])
    both = (
        pairs.join(texts.select(F.col("node").alias("left"), F.col("text").alias("a")).hint("merge"), "left")
        .join(texts.select(F.col("node").alias("right"), F.col("text").alias("b")).hint("merge"), "right")
        .select("left", "right", "a", "b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 2):
            sets = [[_shingles(t.as_py(), width) for t in batch.column(c)] for c in (2, 3)]
            keep = [len(a & b) >= least * len(a | b) for a, b in zip(*sets)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "left bigint, right bigint")


_ALIKE = f"bit_count(l.s0 ^ r.s0) + bit_count(l.s1 ^ r.s1) <= {SKETCH}"


def _similar_links(marked: DataFrame, docs: DataFrame, text_col: str, width: int, radius: int, least: float) -> DataFrame:
    """Links of that similarity among nodes with fingerprints within the radius, equal fingerprints or an equal band."""
    own = marked.groupBy("node").agg(F.min("fp").alias("fp"), F.min("s0").alias("s0"), F.min("s1").alias("s1"), F.min("bands").alias("bands"))  # functions of the text
    own, _ = written(own, "nodes")
    by_fp = own.groupBy("fp").agg(F.min("node").alias("node"))
    pairs = links(by_fp.select("fp"), radius)
    pairs = pairs.join(by_fp.select(F.col("fp").alias("left"), F.col("node").alias("a")).hint("merge"), "left").join(by_fp.select(F.col("fp").alias("right"), F.col("node").alias("b")).hint("merge"), "right")
    # Equal fingerprints are one more band.
    keys = F.concat(F.coalesce("bands", F.array().cast("array<bigint>")), F.array(F.col("fp")))
    bands, _ = written(own.select("node", "s0", "s1", F.posexplode(keys).alias("band", "key")), "bands")
    first = F.min(F.struct("node", "s0", "s1")).alias("first")
    buckets = bands.groupBy("band", "key").agg(first, F.max("node").alias("most")).where("first.node < most").select("band", "key", "first.*")
    buckets, _ = written(buckets, "buckets")
    stars = bands.alias("r").join(buckets.hint("merge").alias("l"), F.expr(f"l.band = r.band AND l.key = r.key AND l.node < r.node AND {_ALIKE}"))
    stars = stars.select(F.col("l.node").alias("left"), F.col("r.node").alias("right"))
    first, _ = written(pairs.select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right")).union(stars).distinct(), "links")
    near, _ = written(_similar(first, docs, text_col, width, least), "near")
    labels = components(near, "left", "right", "node", "label")
    named = bands.join(buckets.select("band", "key").hint("merge"), ["band", "key"], "left_semi").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    named, _ = written(named, "named")
    mixed = named.groupBy("band", "key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("band", "key")
    left, _ = written(named.join(mixed.hint("merge"), ["band", "key"], "left_semi"), "mixed")
    meets = f"l.band = r.band AND l.key = r.key AND l.node < r.node AND l.label <> r.label AND {_ALIKE}"
    rest = left.alias("l").join(left.hint("merge").alias("r"), F.expr(meets)).select(F.col("l.node").alias("left"), F.col("r.node").alias("right")).distinct()
    rest, _ = written(rest.join(first.hint("merge"), ["left", "right"], "left_anti"), "rest")
    return near.union(_similar(rest, docs, text_col, width, least))


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, least_similarity: float | None = None
) -> DataFrame:
    """One row per document: its id, fp (signed long), and component_id, the least id reachable by links.

    With least_similarity, different texts are linked if their shingle sets reach that Jaccard
    similarity; candidates are those with fingerprints within the radius and those with an equal band.
    """
    marked, _ = written(fingerprints(docs, id_col, text_col, width, least_similarity is not None), "fingerprints")
    node = "fp" if least_similarity is None else "node"
    nodes = marked.groupBy(node).agg(F.min(column(id_col)).alias("least_id"))
    if least_similarity is None:
        pairs = links(nodes.select("fp"), radius)
    else:
        pairs, _ = written(_similar_links(marked, docs, text_col, width, radius, least_similarity), "similar")
    labels = components(pairs, "left", "right", node, "label")
    named = nodes.join(labels.hint("merge"), node, "left").withColumn("label", F.coalesce("label", node))
    least = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    by_node = named.join(least.hint("merge"), "label").select(node, "component_id")
    return marked.join(by_node.hint("merge"), node).select(column(id_col), "fp", "component_id")


def keep_one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = 6, least_similarity: float | None = 0.8
) -> DataFrame:
    """The documents without near copies: of each component the one with the least id stays.

    Rows with a null id stay; of rows that repeat an id one stays only if its component is its own id's,
    in which case all rows with that id stay. Other columns are carried along whatever their names.
    """
    groups = simhash_groups(docs.select(column(id_col), column(text_col)), id_col, text_col, width, radius, least_similarity)
    name = fresh(docs, "gone")
    gone = groups.where(column(id_col) != F.col("component_id")).select(column(id_col).alias(name)).distinct()
    return docs.join(gone.hint("merge"), column(id_col) == F.col(name), "left_anti")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    groups = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
