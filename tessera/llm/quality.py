"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a whole text are computed from its bytes and words on the
executors; the trees are fitted on the driver from the statistics (not the texts) of
a bounded sample of labelled documents, flattened into arrays and sent to the
executors, where numpy walks all rows of a batch down all trees level by level.

Defined results: a null text counts as empty; it is scored like any other. Labels
that are null are ignored; with several labels of a document each counts. Without
labels of both classes every score is the share of label 1 (0.5 without any). A null
id is in no fold: it is not held out and never learnt from. An empty table gives no
rows. Repeated rows are scored alike, texts of any length as a whole; other columns are
carried along whatever their names, but score is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.llm.common import by_size, column, crc_bucket, mapped, widened

#: The most labelled documents that a fit uses: those with the smallest hash of the id.
SAMPLE = 20_000
FOLDS, HELD_OUT = 3, 1

_KINDS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9), "line": (10, 13), "beyond": range(128, 256),
    "control": (*range(9), 11, 12, *range(14, 32), 127), "stop": b".", "comma": b",", "shout": b"!?", "symbol": b"#$%&*+=^~@", "bracket": b"()[]{}<>",
    "bar": b"|/\\_-", "quote": b"'\"`:;",
}
_KIND = np.full(256, len(_KINDS), np.uint8)
for _i, _codes in enumerate(_KINDS.values()):
    _KIND[list(_codes)] = _i
FEATURES = (*_KINDS, "bytes", "words", "mean_word", "spread_word", "short_words", "long_words", "distinct_words", "top_word", "lines", "mean_line",
            "repeated_lines", "entropy", "repeats", "ended_words", "capital_words")


def statistics(text: str | None) -> list[float]:
    """The features of a whole text, in the order of FEATURES."""
    raw = (text or "").encode()
    codes = np.frombuffer(raw, np.uint8)
    n = max(1, len(codes))
    counts = np.bincount(codes, minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=len(_KINDS) + 1)[: len(_KINDS)] / n
    words = raw.split()
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = counts[counts > 0] / n
    many = max(1, len(words))
    space = np.isin(_KIND[codes], (3, 4)) if len(codes) else np.zeros(0, bool)
    starts = codes[np.flatnonzero(~space & np.concatenate(([True], space[:-1])))] if len(codes) else codes
    closes = codes[np.flatnonzero(~space & np.concatenate((space[1:], [True])))] if len(codes) else codes
    letters = (2, 0, 1, 5)
    return [
        *kinds.tolist(), np.log1p(len(raw)), np.log1p(len(words)), sizes.mean(), sizes.std(), (sizes <= 2).mean(), (sizes >= 12).mean(), len(seen) / many,
        max(seen.values(), default=0) / many, np.log1p(len(lines)), np.log1p(len(raw) / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)),
        float(-(share * np.log2(share)).sum()), float((codes[1:] == codes[:-1]).mean()) if len(codes) > 1 else 0.0,
        float((~np.isin(_KIND[closes], letters)).mean()) if len(closes) else 0.0, float((_KIND[starts] == 0).mean()) if len(starts) else 0.0,
    ]


class Trees:
    """Boosted trees for two classes. Nodes of all trees lie in flat arrays; a leaf points to itself."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, smoothing: float = 1.0, least: int = 5):
        self.rounds, self.depth, self.rate, self.bins, self.smoothing, self.least = rounds, depth, rate, bins, smoothing, least
        self.feature = np.zeros(0, np.int32)
        self.cut, self.value = np.zeros(0), np.zeros(0)
        self.child, self.roots = np.zeros((0, 2), np.int32), np.zeros(0, np.int32)
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, prior = len(y), float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        self.start = float(np.log(prior / (1 - prior)))
        if n == 0 or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        raw = np.full(n, self.start)
        feature, cut, value, child, roots = [], [], [], [], []

        def node(leaf: float) -> int:
            feature.append(0), cut.append(np.inf), value.append(leaf), child.append([len(feature) - 1] * 2)
            return len(feature) - 1

        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = y - p, p * (1 - p)
            roots.append(root := node(0.0))
            level = [(root, np.arange(n))]
            for depth in range(self.depth + 1):
                following = []
                for at, rows in level:
                    g, h = grad[rows].sum(), hess[rows].sum()
                    best = self._split(binned[rows], grad[rows], hess[rows], g, h, cuts) if depth < self.depth and len(rows) >= 2 * self.least else None
                    if best is None:
                        value[at] = self.rate * g / (h + self.smoothing)
                        raw[rows] += value[at]
                        continue
                    f, b = best
                    feature[at], cut[at] = f, cuts[f][b]
                    child[at] = [node(0.0), node(0.0)]
                    right = binned[rows, f] > b
                    following += [(child[at][0], rows[~right]), (child[at][1], rows[right])]
                level = following
        self.feature, self.cut, self.value = np.array(feature, np.int32), np.array(cut), np.array(value)
        self.child, self.roots = np.array(child, np.int32), np.array(roots, np.int32)
        return self

    def _split(self, binned, grad, hess, g, h, cuts) -> tuple[int, int] | None:
        """Feature and bin whose split gains most, from histograms of gradients."""
        best, found, own = 1e-6, None, g * g / (h + self.smoothing)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            size = len(c) + 1
            gl = np.cumsum(np.bincount(binned[:, f], weights=grad, minlength=size))[:-1]
            hl = np.cumsum(np.bincount(binned[:, f], weights=hess, minlength=size))[:-1]
            nl = np.cumsum(np.bincount(binned[:, f], minlength=size))[:-1]
            gain = gl**2 / (hl + self.smoothing) + (g - gl) ** 2 / (h - hl + self.smoothing) - own
            gain[(nl < self.least) | (len(grad) - nl < self.least)] = 0
            if gain[b := int(gain.argmax())] > best:
                best, found = gain[b], (f, b)
        return found

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1, for all rows at once."""
        raw = np.full(len(x), self.start)
        if len(self.roots) and len(x):
            at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
            rows = np.arange(len(x))[:, None]
            for _ in range(self.depth):
                at = self.child[at, (x[rows, self.feature[at]] > self.cut[at]).astype(np.int8)]
            raw += self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def _matrix(texts) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in texts], np.float64).reshape(-1, len(FEATURES))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees learnt from at most sample labelled documents outside the held-out fold, chosen by a hash of the id."""
    usable = labels.where(column(label_col).isin(0, 1) & (crc_bucket(column(id_col), FOLDS) != HELD_OUT))
    chosen = usable.select(column(id_col).alias("id"), column(label_col).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    # At most `sample` rows of an id and a label: small enough to broadcast at any size of the corpus.
    texts = docs.select(column(id_col).alias("id"), column(text_col).alias("t")).join(F.broadcast(chosen), "id").select("t", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 0):
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(_matrix(batch.column(0))), pa.list_(pa.float64()))], ["y", "x"])

    found = texts.mapInArrow(run, "y int, x array<double>").toArrow()
    y = found.column("y").to_numpy().astype(np.float64)
    x = np.array(found.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, y))  # so that the fit doesn't depend on the order of arrival
    return Trees().fit(x[order], y[order])


def scored(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with a column score (a column of that name is replaced)."""
    kept = [c for c in docs.columns if c != "score"]
    place = kept.index(text_col)
    model = docs.sparkSession.sparkContext.broadcast(trees)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, place):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.value.score(_matrix(batch.column(place))))], [*kept, "score"])

    return mapped(docs.select(*map(column, kept)), run, widened(docs, kept, {"score": DoubleType()}))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    trees = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))

    return scored(docs, trees).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
