"""Line dedup by winnowing over line hashes.

Lines are cut into units: a line ends a unit, and so does, inside a line, the word with
the least hash of every few neighbouring words, so that a passage pasted into a longer
line has the same units there. A gram is the shortest run of units from a unit on with
at least so many words. Of all grams in a window (the shortest run of units with the
window's words) the one with the least hash is selected, and only selected grams are
written and joined: a repeated run of `least_words` words, in lines of its own or inside
others, holds a whole window of equal units and so the same selected gram. Windows
overlap, so that the fingerprints of a repeated run overlap too.

A fingerprint is joined with the place of its first occurrence in the order of ids and
places, never with all others: the join is linear however often a passage is repeated.
Overlapping places with the same shift are one span, and the words on both sides of the
first occurrence, fetched once for each place, extend it both ways word by word up to
`least_words` words (a longer run has fingerprints of its own). What reaches
`least_words` words in all is deleted from the later document; the earliest stays.

Each deleted word has an equal one earlier in the order, and the first of a chain is
never deleted, so no passage disappears from the corpus. A passage is missed if all its
fingerprints occur first in other documents without `least_words` words of it.

Defined results: a null text stays null and an empty one empty; a line of which all
words went goes, of other lines the rest stays; lines without words stay unless they lie
inside a deleted run; of a run that repeats itself (ab ab ab) `least_words` words stay;
rows that repeat both id and text are one document and are treated alike; null ids come
last in the order; an empty table gives no rows. Other columns are carried along
whatever their names, but removed_lines and removed_words are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessera.llm.common import by_size, column, fresh, mapped, widened, written

#: Passages of at least so many words are found.
LEAST_WORDS = 50
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(29)
_POWERS = np.cumprod(np.full(4096, _BASE, np.uint64))


def sizes(least: int) -> tuple[int, int, int]:
    """For passages of so many words: the words of a cut inside a line, of a gram and of a window.

    A run loses at most a cut's words at each end before its first and after its last whole unit.
    """
    cut = max(1, least // 6)
    window = max(1, least - 2 * cut)
    return cut, max(1, window * 3 // 5), window


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _MIX
    return x ^ (x >> _SHIFT)


class Words:
    """All words of some texts, side by side: the bytes where they start and end, their lines, texts and hashes."""

    def __init__(self, texts: list[bytes]):
        raw = b"\n".join(texts) + b"\n"  # so no line crosses two texts
        codes = np.frombuffer(raw, np.uint8)
        inside = ~_SPACE[codes]
        edges = np.flatnonzero(np.diff(inside, prepend=False))
        self.start, self.end = edges[::2], edges[1::2]
        self.line = np.searchsorted(np.flatnonzero(codes == 10), self.start)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        self.text = np.searchsorted(begins, self.start, side="right") - 1
        self.first = np.searchsorted(self.text, np.arange(len(texts)))
        self.hash = np.zeros(len(self.start), np.uint64)
        sized, at = self.end - self.start, 0
        upto = np.cumsum(sized)
        while at < len(sized):  # in blocks, so that what is made of a very long text stays small
            last = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (4 << 20))))
            self.hash[at:last] = self._hashed(codes[self.start[at] : self.end[last - 1]], sized[at:last])
            at = last

    @staticmethod
    def _hashed(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        own = codes[~_SPACE[codes]]
        starts = np.cumsum(lengths) - lengths
        place = np.arange(len(own)) - np.repeat(starts, lengths)
        return _mixed(np.add.reduceat((own + np.uint64(1)) * _POWERS[place & 4095], starts) + lengths.astype(np.uint64))


def units(words: Words, cut: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where units start and end, in words, and their hashes."""
    n = len(words.line)
    closes = np.ones(n, bool)
    if cut > 1:
        closes[:-1] = words.line[1:] != words.line[:-1]
        if n >= cut:
            least = np.lib.stride_tricks.sliding_window_view(words.hash, cut).argmin(axis=1)
            within = words.line[: n - cut + 1] == words.line[cut - 1 :]
            closes[(np.arange(n - cut + 1) + least)[within]] = True
    ends = np.flatnonzero(closes) + 1
    starts = np.concatenate(([0], ends[:-1])) if n else ends
    if not n:
        return starts, ends, np.zeros(0, np.uint64)
    place = np.arange(n) - np.repeat(starts, ends - starts)
    return starts, ends, _mixed(np.add.reduceat(words.hash * _POWERS[place], starts))


def selected(words: Words, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The grams that some window selects: their texts, hashes, and first and last words (excluded), numbered within the text."""
    cut, gram, window = sizes(least)
    starts, ends, own = units(words, cut)
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    text = words.text[starts]
    last = np.searchsorted(ends, starts + gram)  # a gram's last unit
    hashed = np.zeros(n, np.uint64)
    padded = np.concatenate([own, np.zeros(gram, np.uint64)])
    for i in range(int((np.minimum(last, n - 1) - np.arange(n)).max()) + 1):
        inside = np.arange(n) + i <= last
        hashed[inside] = hashed[inside] * _BASE + padded[i : i + n][inside]
    hashed = _mixed(hashed)
    close = np.searchsorted(ends, starts + window)
    whole = np.flatnonzero((close < n) & (text[np.minimum(close, n - 1)] == text))
    if not len(whole):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    order = np.argsort(hashed, kind="stable")  # of equal grams the first
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = np.arange(n), n
    beyond = np.searchsorted(last, close[whole], side="right")
    least_rank = np.minimum.reduceat(rank, np.stack([whole, beyond], axis=1).ravel())[::2]
    chosen = np.unique(order[least_rank])
    chosen = chosen[_apart(hashed[chosen], starts[chosen], ends[last[chosen]])]
    base = words.first[text[chosen]]
    return text[chosen], hashed[chosen].view(np.int64), (starts[chosen] - base).astype(np.int32), (ends[last[chosen]] - base).astype(np.int32)


def _apart(hashed: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of a chain of equal grams that overlap the first two and those that don't overlap the last one taken: a run that repeats itself needs no gram for each word."""
    keep = np.ones(len(hashed), bool)
    chained = np.concatenate(([False], (hashed[1:] == hashed[:-1]) & (low[1:] < high[:-1])))
    upto = 0
    for i in np.flatnonzero(chained).tolist():
        keep[i] = not chained[i - 1] or low[i] >= upto
        upto = high[i] if keep[i] else upto
    return np.flatnonzero(keep)


def _encoded(texts: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()]


def _key(id_col: str, text_col: str) -> Column:
    """128 bits of an id and its text: what names a document."""
    return F.unhex(F.md5(F.concat(F.coalesce(column(id_col).cast("string"), F.lit("")), F.lit("\n"), F.coalesce(column(text_col), F.lit(""))).cast("binary")))


def _entries(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """The selected grams of all documents: a and id name the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 2):
            owner, fp, low, high = selected(Words(_encoded(batch.column(2))), least)
            taken = pa.array(owner)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), pa.array(low), pa.array(high), pa.array(fp)], ["a", "id", "low", "high", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(_key(id_col, text_col).alias("a"), column(id_col).alias("id"), column(text_col).alias("text"))
    return source.mapInArrow(run, f"a binary, id {kind}, low int, high int, fp bigint")


def _matches(entries: DataFrame) -> DataFrame:
    """Spans of a document a that an earlier place, `shift` words before in document b, holds too."""
    order = F.struct(F.col("id").isNull().alias("none"), "id", F.col("a").alias("b"), F.col("low").alias("at"))
    # The first occurrence is a fixed-width minimum that partial aggregates keep small.
    firsts = entries.groupBy("fp").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("fp", "first.b", "first.at")
    firsts, _ = written(firsts, "firsts")
    met = entries.join(firsts, "fp").where("a <> b OR low <> at").select("a", "b", (F.col("low") - F.col("at")).alias("shift"), "low", "high")
    # Overlapping grams of the same shift are one span. A partition is a part of one document's own grams.
    along = Window.partitionBy("a", "b", "shift").orderBy("low", "high")
    opens = F.coalesce(F.col("low") > F.max("high").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    numbered = met.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(along))
    return numbered.groupBy("a", "b", "shift", "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("run")


def _contexts(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """Hashes of the words before (nearest first) and after the places that spans name in first occurrences: b, at, after, words."""
    asked = spans.groupBy("b").agg(F.collect_set(F.col("low") - F.col("shift")).alias("lows"), F.collect_set(F.col("high") - F.col("shift")).alias("highs"))  # a document's own places
    source = docs.select(_key(id_col, text_col).alias("b"), column(text_col).alias("text")).join(asked.hint("merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 1):
            rows = []
            for b, text, lows, highs in zip(batch.column(0).to_pylist(), _encoded(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                near = Words([text]).hash.astype("<u4")
                rows += [(b, at, False, near[max(0, at - least) : at][::-1].tobytes()) for at in lows]
                rows += [(b, at, True, near[at : at + least].tobytes()) for at in highs]
            columns = zip(*rows) if rows else ([], [], [], [])
            kinds = [pa.binary(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["b", "at", "after", "words"])

    return source.select("b", "text", "lows", "highs").mapInArrow(run, "b binary, at int, after boolean, words binary").dropDuplicates(["b", "at", "after"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """For each document a with matches the list `spans`: low, high, shift and the words around the first occurrence, own if that lies in a itself."""
    entries, _ = written(_entries(docs, id_col, text_col, least_words), "grams")
    spans, _ = written(_matches(entries), "matches")
    contexts, _ = written(_contexts(docs, spans, id_col, text_col, least_words), "contexts")
    before = contexts.where("NOT after").select("b", F.col("at").alias("from"), F.col("words").alias("before"))
    after = contexts.where("after").select("b", F.col("at").alias("upto"), F.col("words").alias("behind"))
    placed = spans.withColumn("from", F.col("low") - F.col("shift")).withColumn("upto", F.col("high") - F.col("shift"))
    told = placed.join(before, ["b", "from"]).join(after, ["b", "upto"])
    own = (F.col("a") == F.col("b")).alias("own")
    return told.groupBy("a").agg(F.collect_list(F.struct("low", "high", "shift", own, "before", "behind")).alias("spans"))  # a document's own grams


def _alike(a: np.ndarray, b: bytes) -> int:
    """How many words two lists of hashes have in common from their start."""
    b = np.frombuffer(b, "<u4")
    n = min(len(a), len(b))
    different = np.flatnonzero(a[:n] != b[:n])
    return int(different[0]) if len(different) else n


def without(text: str, spans: list[dict], least: int) -> tuple[str, int, int]:
    """A text without the spans that reach least words when extended both ways, and how many lines lost words and how many words went."""
    raw = text.encode()
    words = Words([raw])
    near, gone = words.hash.astype("<u4"), np.zeros(len(words.hash), bool)
    for span in spans:
        low, high = span["low"], span["high"]
        low -= _alike(near[max(0, low - least) : low][::-1], span["before"])
        high += _alike(near[high : high + least], span["behind"])
        if high - low >= least:
            gone[max(low, low - span["shift"] + least) if span["own"] else low : high] = True
    if not gone.any():
        return text, 0, 0
    lines, out, at = raw.split(b"\n"), [], 0
    ends = np.searchsorted(words.line, np.arange(len(lines) + 1)).tolist()
    totals = np.concatenate(([0], np.cumsum(gone))).tolist()
    for line, low, high in zip(lines, ends, ends[1:]):
        lost = totals[high] - totals[low]
        if 0 < lost < high - low:
            kept, cut = [], 0
            for w in (np.flatnonzero(gone[low:high]) + low).tolist():
                kept.append(line[cut : words.start[w] - at])
                cut = (words.start[w + 1] if w + 1 < high else at + len(line)) - at
            out.append((b"".join(kept) + line[cut:]).rstrip())
        elif not (lost if low < high else 0 < low < len(gone) and gone[low - 1] and gone[low]):
            out.append(line)
        at += len(line) + 1
    return b"\n".join(out).decode(), len(np.unique(words.line[gone])), int(gone.sum())


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents without repeated passages; removed_lines and removed_words, how many lines lost words and how many words went."""
    lists, _ = written(repeated_spans(docs, id_col, text_col, least_words), "spans")
    kept = [c for c in docs.columns if c not in ("removed_lines", "removed_words")]
    place, key, spans = kept.index(text_col), fresh(docs, "key"), fresh(docs, "spans")
    # A merge join at every size: the lists grow with the corpus, so the plan must not turn on their fitting a broadcast.
    named = docs.select(*map(column, kept), _key(id_col, text_col).alias(key))
    joined = named.join(lists.select(F.col("a").alias(key), F.col("spans").alias(spans)).hint("merge"), key, "left").drop(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, place):
            told = [
                (text, 0, 0) if not found or text is None else without(text, found, least_words)
                for text, found in zip(batch.column(place).to_pylist(), batch.column(len(kept)).to_pylist())
            ]
            texts, lines, words = zip(*told) if told else ((), (), ())
            columns = list(batch.columns[: len(kept)])
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(words, pa.int64())], [*kept, "removed_lines", "removed_words"])

    return mapped(joined, run, widened(docs, kept, {"removed_lines": LongType(), "removed_words": LongType()}))


def op4_lines(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicated(docs)
