"""LM scoring by the likelihood of a subword lattice.

A text's words and its end are the edges of a lattice; a word can be cut into the pieces
of an existing subword vocabulary in every possible way. The probability of a text is
the sum over all segmentations, found by a forward recursion in log space; segmentations
of different words are independent, so it is a product of the words' marginals::

    P(text) = e * product over words of (1 - e) * L(word)
    L(word) = sum over segmentations of the product of the pieces' weights

The pieces' weights start from the vocabulary's scores and are fitted, the vocabulary
staying as it is, by a few rounds of expected counts over all training words (rounds=0:
the vocabulary's own scores); e is the share of ends among the training tokens. P sums
to at most 1. This is `score`. Beside it `mixture_score` is the model in which a word that
the training documents have may also be taken whole, with the lattice as what is left::

    M(word) = max(c - d, 0) / N + (d * V / N) * L(word)

c, N and V are the word's count, all tokens and the distinct words of the training
documents, d is the discount n1 / (n1 + 2 n2) of their counts of counts.

Words of over LONG bytes are cut into blocks whose recursions run side by side, one for
each place that a piece crossing the block's start can begin at, so that a text without
spaces takes no step for each byte.

Plan: documents are tokenized once, in blocks of about 16 MB, into numbers of the
block's own words; only a block's distinct words are shuffled by word, meet their
counts and marginals, and go back to their block. Texts are not shuffled, and no
group is larger than a block. Of the corpus the driver gets a few counts and, in each
round, one number for each piece of the vocabulary; the table of words grows with it.

Defined results: a null text counts as empty; an empty text is only its end; a null id
is neither held out nor learnt from; repeated rows are scored alike, each counts; words
of any length are scored; an empty table gives no rows; without training documents the
pieces keep the vocabulary's scores and the end is certain. Other columns are ignored
whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_size, column, crc_bucket, shuffle_partitions, written

FOLDS, HELD_OUT = 5, 1
BLOCK = 16 << 20
ROUNDS = 3
#: Distinct words that a task scores, and words of blocks that a task joins, whatever spark.sql.shuffle.partitions says.
WORDS, JOINED = 200_000, 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a sentencepiece model as bytes, the word mark as a space, and their log weights.

    Pieces are folded to lower case, pieces with a mark inside are left out, and every byte is a piece,
    so that each word has a segmentation. The file's scores are ranks: weights fall with the rank.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {bytes([b]): 0.0 for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode().lower()
        if b" " not in piece[1:]:
            weight[piece] = weight.get(piece, 0.0) + 1 / (10 + abs(model.get_score(i)))
    pieces = sorted(weight)
    mass = np.array([weight[p] for p in pieces]) + 1e-6
    return pieces, np.log(mass / mass.sum())


class Lattice:
    """Marginals of words over all segmentations into weighted pieces."""

    CELLS = 1 << 16
    #: Longer words are cut into blocks of SPAN bytes, SIDE of them at once.
    LONG, SPAN, SIDE = 2048, 256, 512

    def __init__(self, pieces: list[bytes]):
        self.size, self.most = len(pieces), max(map(len, pieces))
        by_length: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            by_length.setdefault(len(piece), []).append(i)
        self.tables = {}
        with np.errstate(over="ignore"):
            for n, ids in sorted(by_length.items()):
                codes = np.frombuffer(b"".join(pieces[i] for i in ids), np.uint8).reshape(-1, n)
                keys = self._prefixes(codes)[:, n]
                order = np.argsort(keys)
                self.tables[n] = keys[order], np.array(ids, np.int64)[order], _BASE ** np.uint64(n)

    @staticmethod
    def _prefixes(codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        for j in range(codes.shape[1]):
            out[:, j + 1] = out[:, j] * _BASE + codes[:, j].astype(np.uint64) + np.uint64(1)
        return out

    def _found(self, codes: np.ndarray) -> dict[int, np.ndarray]:
        """By piece length, the piece at each start (size: none)."""
        hashed, found = self._prefixes(codes), {}
        for n, (keys, ids, power) in self.tables.items():
            if n <= codes.shape[1]:
                wanted = hashed[:, n:] - hashed[:, :-n] * power
                place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                found[n] = np.where(keys[place] == wanted, ids[place], self.size)
        return found

    def _batches(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]]:
        """Words of like length, long ones left out: their numbers, their lengths and, by piece length, the piece at each start."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order, at = np.argsort(sizes, kind="stable"), 0
        order = order[: np.searchsorted(sizes[order], self.LONG, side="right")]
        with np.errstate(over="ignore"):
            while at < len(order):
                upto = at + 1
                while upto < len(order) and (upto - at + 1) * sizes[order[upto]] <= self.CELLS:
                    upto += max(1, min(64, (len(order) - upto) // 64))
                upto = min(upto, len(order))
                rows = order[at:upto]
                longest = int(sizes[rows[-1]])
                flat = np.zeros((len(rows), longest), np.uint8)
                flat[np.arange(longest) < sizes[rows][:, None]] = np.frombuffer(b"".join([words[r] for r in rows]), np.uint8)
                yield rows, sizes[rows], self._found(flat)
                at = upto

    @staticmethod
    def _log_sum(parts: list[np.ndarray]) -> np.ndarray:
        stacked = np.stack(parts)
        top = stacked.max(axis=0)
        safe = np.where(np.isfinite(top), top, 0)
        with np.errstate(divide="ignore"):
            return safe + np.log(np.exp(stacked - safe).sum(axis=0))

    def _forward(self, found: dict[int, np.ndarray], logs: np.ndarray, count: int, longest: int) -> np.ndarray:
        alpha = np.full((longest + 1, count), -np.inf)
        alpha[0] = 0
        for j in range(1, longest + 1):
            alpha[j] = self._log_sum([alpha[j - n] + logs[ids[:, j - n]] for n, ids in found.items() if n <= j])
        return alpha

    # A long word. The state at a place is the row of the logs of what reaches it and the places before it, nearest first.

    def _parts(self, word: bytes) -> list[tuple[int, int, int]]:
        """(start, number of blocks, their length): whole blocks, then the rest."""
        whole = (len(word) - 1) // self.SPAN
        parts = [(i * self.SPAN, min(self.SIDE, whole - i), self.SPAN) for i in range(0, whole, self.SIDE)]
        return [*parts, (whole * self.SPAN, 1, len(word) - whole * self.SPAN)]

    def _starts(self, word: bytes, start: int, blocks: int, span: int) -> dict[int, np.ndarray]:
        """By piece length, the piece at each place of each block and of the `most` places before it, (blocks, span + most)."""
        low, high, found = max(0, start - self.most), start + blocks * span, {}
        with np.errstate(over="ignore"):
            told = self._found(np.frombuffer(word[low:high], np.uint8)[None])
        place = start - self.most + np.arange(blocks)[:, None] * span + np.arange(span + self.most)
        for n, ids in told.items():
            within = (place >= low) & (place + n <= high)
            found[n] = np.where(within, ids[0][np.clip(place - low, 0, ids.shape[1] - 1)], self.size)
        return found

    def _run(self, found: dict[int, np.ndarray], logs: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The forward logs from the places before the blocks' starts on, (most + span, blocks, states), of states (most, blocks, states)."""
        most = self.most
        span = next(iter(found.values())).shape[1] - most
        out = np.full((most + span, *state.shape[1:]), -np.inf)
        out[:most] = state[::-1]
        for t in range(most, most + span):
            out[t] = self._log_sum([out[t - n] + logs[ids[:, t + 1 - n]][:, None] for n, ids in found.items()])
        return out

    def _maps(self, found: dict[int, np.ndarray], logs: np.ndarray, blocks: int) -> np.ndarray:
        """The logs that each block's end state has of each start state, (most, blocks, most): sums of products, scaled in between."""
        most, chance = self.most, np.exp(logs)
        weights = {n: chance[ids] for n, ids in found.items()}
        span = next(iter(found.values())).shape[1] - most
        out, scale = np.zeros((most + span, blocks, most)), np.zeros(blocks)
        out[np.arange(most), :, most - 1 - np.arange(most)] = 1
        for t in range(most, most + span):
            for n, w in weights.items():
                out[t] += out[t - n] * w[:, t + 1 - n, None]
            if t % 8 == 0 or t == most + span - 1:
                window = out[t - most + 1 : t + 1]
                top = window.max(axis=(0, 2))
                window /= top[:, None]
                scale += np.log(top)
        with np.errstate(divide="ignore"):
            return np.log(out[-most:][::-1]) + scale[:, None]

    def _crossings(self, word: bytes, logs: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each part the maps of its blocks from state to state, (most, blocks, most), and the states before them, (most, blocks, 1)."""
        most, state, maps, states = self.most, np.full(self.most, -np.inf), [], []
        state[0] = 0
        for start, blocks, span in self._parts(word):
            each = self._maps(self._starts(word, start, blocks, span), logs, blocks)
            before = np.empty((most, blocks, 1))
            for i in range(blocks):
                before[:, i, 0] = state
                state = self._log_sum(list((each[:, i] + state).T))
            maps.append(each), states.append(before)
        return maps, [*states, state]

    def _long_expected(self, word: bytes, logs: np.ndarray) -> np.ndarray:
        maps, states = self._crossings(word, logs)
        whole, most, total = states[-1][0], self.most, np.zeros(self.size + 1)
        rest = np.full(most, -np.inf)  # what completes the word from each place of a state without meeting its other places
        rest[0] = 0
        for (start, blocks, span), each, before in reversed(list(zip(self._parts(word), maps, states))):
            beyond = np.empty((most, blocks))
            for i in range(blocks - 1, -1, -1):
                beyond[:, i] = rest
                rest = self._log_sum(list(each[:, i] + rest[:, None]))
            found = self._starts(word, start, blocks, span)
            alpha = self._run(found, logs, before)[..., 0]
            beta = np.full((most + span, blocks), -np.inf)
            for t in range(most + span - 1, -1, -1):  # place t - most + 1 of the block; the last is its end
                left = most + span - 1 - t
                reached = [logs[ids[:, t + 1]] + beta[t + n] for n, ids in found.items() if n <= left]
                beta[t] = self._log_sum([*reached, beyond[left]] if left < most else reached)
            for n, ids in found.items():  # pieces that end in a block
                low = max(0, most - n)
                share = np.exp(alpha[low : most + span - n] + logs[ids[:, low + 1 : most + span - n + 1]].T + beta[low + n :] - whole)
                total += np.bincount(ids[:, low + 1 : most + span - n + 1].T.ravel(), weights=share.ravel(), minlength=self.size + 1)
        return total

    def marginals(self, words: list[bytes], weights: np.ndarray) -> np.ndarray:
        """Natural logs of the words' probabilities under the log weights; a word starts with its mark, a space."""
        out, logs = np.zeros(len(words)), np.append(weights, -np.inf)
        for rows, sizes, found in self._batches(words):
            out[rows] = self._forward(found, logs, len(rows), int(sizes[-1]))[sizes, np.arange(len(rows))]
        for i, word in enumerate(words):
            if len(word) > self.LONG:
                out[i] = self._crossings(word, logs)[1][-1][0]
        return out

    def expected(self, words: list[bytes], weights: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        """How often each piece is expected in segmentations of the words, each taken as often as counts says, under the log weights."""
        total, logs = np.zeros(self.size + 1), np.append(weights, -np.inf)
        counts = np.ones(len(words)) if counts is None else counts
        for rows, sizes, found in self._batches(words):
            longest, each = int(sizes[-1]), np.arange(len(rows))
            alpha = self._forward(found, logs, len(rows), longest)
            whole = alpha[sizes, each]
            beta = np.full((longest + 1, len(rows)), -np.inf)
            beta[sizes, each] = 0
            for i in range(longest - 1, -1, -1):
                reached = self._log_sum([logs[ids[:, i]] + beta[i + n] for n, ids in found.items() if i + n <= longest])
                beta[i] = np.where(i < sizes, reached, beta[i])
                for n, ids in found.items():
                    if i + n <= longest:
                        share = np.exp(alpha[i] + logs[ids[:, i]] + beta[i + n] - whole) * counts[rows]
                        total += np.bincount(ids[:, i], weights=share, minlength=self.size + 1)
        for word, count in zip(words, counts):
            if len(word) > self.LONG:
                total += count * self._long_expected(word, logs)
        return total[:-1]


_DOC, _WORD = 0, 1


def _packed(numbers: np.ndarray) -> bytes:
    """Word numbers by byte planes, compressed: the high planes are mostly zeros."""
    return zstandard.ZstdCompressor(level=3).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return raw.reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def tokenized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents (kind 0: a text as numbers of its block's words) and of words (kind 1: a block's word, its number and training count).

    learnt: the document is one to learn from.
    """
    fold = crc_bucket(column(id_col), FOLDS)
    source = docs.select(column(id_col).alias("id"), column(text_col).alias("text"), (fold == HELD_OUT).alias("held_out"), F.coalesce(fold != HELD_OUT, F.lit(False)).alias("learnt"))
    kind = source.schema["id"].dataType.simpleString()

    def documents(ids, folds, learnt, tokens, block) -> pa.RecordBatch:
        n = len(tokens)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, _DOC, np.int32)), pa.array(np.full(n, block)), ids, folds, learnt, pa.array(tokens, pa.binary()),
             pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], columns)

    def words_of(words, start, counts, id_type, block) -> pa.RecordBatch:
        n = len(words)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, _WORD, np.int32)), pa.array(np.full(n, block)), pa.nulls(n, id_type), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary()),
             pa.array(np.arange(start, start + n, dtype=np.int32)), pa.array(words, pa.binary()), pa.array(counts)], columns)

    columns = ["kind", "block", "id", "held_out", "learnt", "tokens", "number", "word", "count"]

    def emit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = uuid.uuid4().int >> 65
        numbers: dict[bytes, int] = {}
        learnt: list[np.ndarray] = [np.zeros(0, np.int32)]
        for batch in held:
            tokens = []
            for text, learns in zip(batch.column(1), batch.column(3).to_pylist()):
                words = (text.as_py() or "").encode().lower().split()
                for w in words:
                    if w not in numbers:
                        numbers[w] = len(numbers)
                found = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
                tokens.append(_packed(found))
                if learns:
                    learnt.append(found)
            yield documents(batch.column(0), batch.column(2), batch.column(3), tokens, block)
        counts = np.bincount(np.concatenate(learnt), minlength=len(numbers)).astype(np.int64)
        words = list(numbers)
        for i in range(0, len(words), 20_000):
            yield words_of(words[i : i + 20_000], i, counts[i : i + 20_000], held[0].column(0).type, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in by_size(batches, 1, BLOCK // 8):
            held.append(batch)
            size += batch.column(1).nbytes
            if size >= BLOCK:
                yield from emit(held)
                held, size = [], 0
        if held:
            yield from emit(held)

    types = ["int", "bigint", kind, "boolean", "boolean", "binary", "int", "binary", "bigint"]
    return source.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in zip(columns, types)))


def _expected(words: DataFrame, pieces: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces over all occurrences of the words."""
    shared = words.sparkSession.sparkContext.broadcast((pieces, weights))  # a vocabulary, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, weights = shared.value
        lattice = Lattice(pieces)
        total = np.zeros(lattice.size)
        for batch in batches:
            total += lattice.expected([b" " + w for w in batch.column(0).to_pylist()], weights, batch.column(1).to_numpy().astype(np.float64))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["piece", "n"])

    sums = words.mapInArrow(run, "piece bigint, n double").groupBy("piece").agg(F.sum("n")).collect()  # a row a piece
    out = np.zeros(len(pieces))
    for piece, n in sums:
        out[piece] = n
    return out


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5


def scored(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score and mixture_score (log10 probabilities)."""
    spark = docs.sparkSession
    table, path = written(tokenized(docs, id_col, text_col), "tokens")
    in_blocks = table.where(F.col("kind") == _WORD).select("block", "number", "word", "count")
    # Lattices are slow work on small rows: tasks are cut by words, not by bytes.
    rows = in_blocks.count()
    tasks, joins = (max(shuffle_partitions(spark), math.ceil(rows / most)) for most in (WORDS, JOINED))
    words, _ = written(in_blocks.repartition(joins, "word").groupBy("word").agg(F.sum("count").alias("count")), "words")
    dealt = words.repartition(tasks)
    again = spark.read.schema(table.schema).parquet(path)  # the cogroup's sides need attributes of their own
    texts = again.where(F.col("kind") == _DOC).select("block", "id", "held_out", "tokens")
    learnt = table.where((F.col("kind") == _DOC) & F.col("learnt")).count()
    count = F.col("count")
    total, distinct, once, twice = words.agg(F.coalesce(F.sum(count), F.lit(0)), F.count_if(count > 0), F.count_if(count == 1), F.count_if(count == 2)).first()
    discount = _discount(once, twice)
    pieces, weights = vocabulary(vocabulary_path)
    for _ in range(rounds if distinct else 0):
        found = _expected(dealt.where(count > 0), pieces, weights) + 1e-3
        weights = np.log(found / found.sum())
    n, v = int(total + learnt), distinct + bool(learnt)
    shared = spark.sparkContext.broadcast((pieces, weights))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, weights = shared.value
        lattice = Lattice(pieces)
        for batch in batches:
            spelt = lattice.marginals([b" " + w for w in batch.column(0).to_pylist()], weights)
            mixed = spelt
            if n:
                with np.errstate(divide="ignore"):
                    whole = np.log(np.maximum(batch.column(1).to_numpy() - discount, 0) / n)
                mixed = np.logaddexp(whole, math.log(max(discount * distinct, 0.5) / n) + spelt)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spelt / math.log(10)), pa.array(mixed / math.log(10)), batch.column(1)], ["word", "spelt", "mixed", "count"])

    valued = dealt.mapInArrow(values, "word binary, spelt double, mixed double, count bigint")
    back = in_blocks.select("block", "number", "word").repartition(joins, "word").join(valued.repartition(joins, "word"), "word").select("block", "number", "spelt", "mixed", "count")
    end, on = (math.log10(learnt / n), math.log10(total / n) if total else 0.0) if learnt else (0.0, 0.0)
    end_base = math.log10((learnt + 0.5) / (n + 0.5 * (v + 1)))
    end_known = int(bool(learnt))

    def score(texts: pa.Table, told: pa.Table) -> pa.Table:
        size = told.num_rows
        number = told.column("number").to_numpy()
        spelt, mixed, base, known = np.zeros(size), np.zeros(size), np.zeros(size), np.zeros(size, np.int64)
        spelt[number], mixed[number] = told.column("spelt").to_numpy(), told.column("mixed").to_numpy()
        count = told.column("count").to_numpy()
        base[number], known[number] = np.log10((count + 0.5) / (n + 0.5 * (v + 1))), count > 0
        rows = []
        for tokens in texts.column("tokens").to_pylist():
            t = _unpacked(tokens)
            rows.append((len(t) + 1, int(known[t].sum()) + end_known, float(base[t].sum()) + end_base, float(spelt[t].sum()) + len(t) * on + end, float(mixed[t].sum()) + end))
        lengths, knowns, bases, scores, mixtures = zip(*rows) if rows else ((), (), (), (), ())
        arrays = [
            texts.column("id"), texts.column("held_out").fill_null(False), pa.array(lengths, pa.int64()), pa.array(knowns, pa.int64()),
            pa.array([n] * len(rows), pa.int64()), pa.array(bases, pa.float64()), pa.array(scores, pa.float64()), pa.array(mixtures, pa.float64()),
        ]
        return pa.table(arrays, names=names)

    names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "mixture_score"]
    kind = docs.schema[id_col].dataType.simpleString()
    result = f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, mixture_score double"
    texts, back = (side.repartition(joins, "block") for side in (texts, back))
    return texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(score, result).withColumnRenamed("id", id_col)


def op2_lattice_lm(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, public_tokenizers.path("piece_bpe_32k.model"))
