"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, the
greatest response of each filter feeds a softmax over the languages. A text of any
length is cut into windows that cover the whole of it, and the windows' logits are
averaged. Training runs on the driver on windows of a bounded sample of documents.

Defined results: `und` with score 0 for a null text and for one without a letter, and
for all texts if nothing could be learnt; null languages and null ids are never learnt
from; a null id is not held out; repeated rows get the same answer, texts of any length
are read as a whole; an empty table gives no rows. Other columns are carried along
whatever their names, but lang_pred and score are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from tessera.llm.common import by_size, column, crc_bucket, mapped, widened

#: About so many documents of each language are learnt from, and no more than so many in all; so many bytes of each,
#: and so many languages, the most frequent ones.
PER_LANG, SAMPLE, PIECE, LANGS = 1_000, 40_000, 4_096, 1_000
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


class ByteCnn:
    """Embedding, convolutions of several widths, max pooling, softmax."""

    WINDOW, WIDTHS, FILTERS, DIM = 256, (2, 3, 4, 5), 8, 8

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.reach = langs, max(self.WIDTHS)
        n = self.FILTERS * len(self.WIDTHS)
        self.embed = rng.normal(0, 0.3, (256, self.DIM)).astype(np.float32)
        self.embed[0] = 0  # the padding
        # One matrix for all widths: rows beyond a filter's width stay zero.
        self.mask = np.zeros((self.reach, self.DIM, n), np.float32)
        for i, width in enumerate(self.WIDTHS):
            self.mask[:width, :, i * self.FILTERS : (i + 1) * self.FILTERS] = 1
        self.mask = self.mask.reshape(-1, n)
        self.filters = (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.1, (n, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def windows(self, raw: bytes) -> np.ndarray:
        """All windows of a text, each with the next bytes that the widest filter reaches, zeros behind the end."""
        count, wide = max(1, -(-len(raw) // self.WINDOW)), self.WINDOW + self.reach - 1
        flat = np.zeros(count * self.WINDOW + self.reach - 1, np.uint8)
        flat[: len(raw)] = np.frombuffer(raw, np.uint8)
        return np.lib.stride_tricks.sliding_window_view(flat, wide)[:: self.WINDOW].copy()

    def _patches(self, x: np.ndarray) -> np.ndarray:
        e = self.embed[x]
        s0, s1, s2 = e.strides
        view = np.lib.stride_tricks.as_strided(e, (len(x), self.WINDOW, self.reach * self.DIM), (s0, s1, s2))
        return np.ascontiguousarray(view)

    def logits(self, x: np.ndarray) -> np.ndarray:
        found = []
        for i in range(0, len(x), 64):
            patches = self._patches(x[i : i + 64])
            response = patches.reshape(-1, patches.shape[2]) @ self.filters
            pooled = response.reshape(len(patches), self.WINDOW, -1).max(axis=1) + self.bias
            found.append(np.maximum(pooled, 0) @ self.out + self.out_bias)
        return np.concatenate(found)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        patches = self._patches(x)
        response = (patches.reshape(-1, patches.shape[2]) @ self.filters).reshape(len(x), self.WINDOW, -1)
        where = response.argmax(axis=1)
        pooled = np.take_along_axis(response, where[:, None], 1)[:, 0] + self.bias
        hidden = np.maximum(pooled, 0)
        z = hidden @ self.out + self.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        dz = p / len(y)
        dpool = (dz @ self.out.T) * (pooled > 0)
        chosen = patches[np.arange(len(x))[:, None], where]
        dfilters = np.einsum("bnk,bn->kn", chosen, dpool) * self.mask
        dembed = np.zeros_like(self.embed)
        back = (dpool[:, :, None] * self.filters.T[None]).reshape(len(x), where.shape[1], self.reach, self.DIM)
        codes = x[np.arange(len(x))[:, None, None], where[:, :, None] + np.arange(self.reach)]
        np.add.at(dembed, codes, back)
        dembed[0] = 0
        return {"embed": dembed, "filters": dfilters, "bias": dpool.sum(0), "out": hidden.T @ dz, "out_bias": dz.sum(0)}

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = 12, steps: int = 700, batch: int = 64, rate: float = 0.01, seed: int = 11) -> ByteCnn:
        """Adam over windows drawn anew in each epoch; their lengths vary, so that short texts are learnt too. Few texts are gone through more often, for about the given steps."""
        rng = np.random.default_rng(seed)
        epochs = max(epochs, math.ceil(steps * batch / max(1, len(texts))))
        names = ("embed", "filters", "bias", "out", "out_bias")
        mean = {k: np.zeros_like(getattr(self, k)) for k in names}
        square, done = {k: np.zeros_like(v) for k, v in mean.items()}, 0
        for epoch in range(epochs):
            cuts = []
            for raw in texts:
                size = self.WINDOW if rng.random() < 0.6 else int(rng.integers(16, self.WINDOW))
                at = int(rng.integers(0, max(1, len(raw) - size + 1)))
                cuts.append(raw[at : at + size])
            x = np.concatenate([self.windows(c) for c in cuts])
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                done += 1
                for k, g in self._gradients(x[rows], y[rows]).items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    change = rate * (1 - epoch / epochs) * (mean[k] / (1 - 0.9**done)) / (np.sqrt(square[k] / (1 - 0.999**done)) + 1e-8)
                    setattr(self, k, (getattr(self, k) - change).astype(np.float32))
        return self

    def predict(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the language's number and its probability."""
        pieces = [self.windows(r) for r in raws]
        z = self.logits(np.concatenate(pieces))
        ends = np.cumsum([len(p) for p in pieces])
        starts = np.concatenate(([0], ends[:-1]))
        z = np.add.reduceat(z, starts, axis=0).astype(np.float64) / (ends - starts)[:, None]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def _readable(text: str | None) -> bytes | None:
    return text.encode().lower() if text and _LETTER.search(text) else None


def fitted(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", per_lang: int = PER_LANG, sample: int = SAMPLE, piece: int = PIECE, most: int = LANGS) -> ByteCnn | None:
    """A network learnt from about per_lang documents of each language outside the held-out fold; None if there are none.

    A language's documents are drawn by a hash of the id with a probability that its number
    of documents gives, so no language is gathered in one task. Of a drawn document up to
    `piece` bytes from a place that the hash picks are sent to the driver. At most the `most`
    most frequent languages are learnt.
    """
    named = docs.select(column(id_col).alias("id"), column(lang_col).alias("y"), column(text_col).alias("t"))
    usable = named.where(F.col("y").isNotNull() & F.col("t").isNotNull() & (crc_bucket(F.col("id"), FOLDS) != HELD_OUT))
    counts = {r[0]: r[1] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "y").limit(most).collect()}
    if not counts:
        return None
    langs = sorted(counts)
    chance = F.create_map(*[F.lit(v) for k in langs for v in (k, min(1.0, per_lang / counts[k]))])
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = usable.where(draw < chance[F.col("y")]).select("y", "t", F.xxhash64(F.lit(1), "id").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 1):
            rows = []
            for y, t, h in zip(*(c.to_pylist() for c in batch.columns)):
                if (raw := _readable(t)) is not None:
                    at = h % max(1, len(raw) - piece + 1)
                    rows.append((y, raw[at : at + piece], h))
            y, x, h = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.string()), pa.array(x, pa.binary()), pa.array(h, pa.int64())], ["y", "x", "h"])

    found = drawn.mapInArrow(run, "y string, x binary, h bigint").orderBy("h", "y", "x").limit(sample).collect()
    if not found:
        return None
    number = {k: i for i, k in enumerate(langs)}
    return ByteCnn(langs).fit([bytes(r.x) for r in found], np.array([number[r.y] for r in found]))


def identified(docs: DataFrame, model: ByteCnn | None, text_col: str = "text") -> DataFrame:
    """The documents with the columns lang_pred and score (columns of those names are replaced)."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    place = kept.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in by_size(batches, place, 1 << 20):
            raws = [_readable(t.as_py()) if net else None for t in batch.column(place)]
            lang, score = np.full(len(raws), UNKNOWN, object), np.zeros(len(raws))
            if some := [i for i, r in enumerate(raws) if r is not None]:
                best, p = net.predict([raws[i] for i in some])
                lang[some], score[some] = [net.langs[b] for b in best], p
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], [*kept, "lang_pred", "score"])

    return mapped(docs.select(*map(column, kept)), run, widened(docs, kept, {"lang_pred": StringType(), "score": DoubleType()}))


def op10_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fitted(docs)
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return identified(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
