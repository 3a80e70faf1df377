"""Byte-level BPE encoding by backtracking over longest matches, and decoding by an offset table.

A tokenization is the one that merging by rank gives exactly if each token is what
merging makes of its own bytes and every two neighbours are compatible: no merge
across their border comes before the merges that built them. So the encoder takes,
from left to right, the longest token that an Aho-Corasick automaton found at the
position, falls back to shorter ones while the pair is incompatible or the rest is
known to be a dead end, and steps back when none is left. Dead ends are marked, so
a position fails once at most and the time is linear in the text.

Defined results: a null text is encoded as the empty text; it has no tokens and
decodes to the empty text. Other columns are carried along; a column that has an
output's name is replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType

from tessera.llm.common import by_size, column, mapped, widened

#: The white space of the split pattern.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _splitter(module, letters: str, numbers: str, space: str):
    return module.compile(rf" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


def _byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself if visible, else the next from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A vocabulary in the tokenizers library's JSON form, ready to encode and decode."""

    CACHE = 250_000
    PAIRS = 1_000_000

    def __init__(self, source: bytes):
        told = json.loads(source)
        model, letter = told["model"], _byte_letters()
        raw = lambda token: bytes(letter[c] for c in token)
        self.vocab_ids: list[int] = []
        self.text: list[bytes] = []
        number: dict[str, int] = {}
        for token in sorted(letter, key=letter.get):
            number[token] = len(self.text)
            self.text.append(raw(token))
            self.vocab_ids.append(model["vocab"][token])
        self.left, self.right, self.merged = [-1] * 256, [-1] * 256, {}
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            token = a + b
            if token in number:
                raise ValueError(f"two merges make the token {token!r}")
            number[token] = len(self.text)
            self.merged[number[a], number[b]] = len(self.text)
            self.left.append(number[a])
            self.right.append(number[b])
            self.text.append(raw(token))
            self.vocab_ids.append(model["vocab"][token])
        self.size = [len(x) for x in self.text]
        self.packed = [i.to_bytes(4, "little") for i in self.vocab_ids]
        self.pairs: dict[tuple[int, int], bool] = {}
        live = [t < 256 or self._compatible(self.left[t], self.right[t], t) for t in range(len(self.text))]
        index = {x.decode("latin-1"): t for t, x in enumerate(self.text) if live[t]}
        self.shorter = [next((index[x[:n]] for n in range(len(x) - 1, 0, -1) if x[:n] in index), -1) for x in (y.decode("latin-1") for y in self.text)]
        self.automaton = ahocorasick.Automaton()
        for token, t in index.items():
            self.automaton.add_word(token, t)
        self.automaton.make_automaton()
        self.index = index
        self.added = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.split_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.split = _splitter(regex, r"\p{L}", r"\p{N}", SPACE)
        self.split_ascii = _splitter(re, "A-Za-z", "0-9", "\\t-\\r ")
        by_id = dict(zip(self.vocab_ids, self.text)) | {i: x.encode() for x, i in self.added.items()}
        parts = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int64)
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.cache = _Cache(self)

    def _compatible(self, a: int, b: int, before: int = sys.maxsize) -> bool:
        """Whether no merge across the border of a and b comes before the merges that made them.

        Undoes the later of the two merges at the border step by step; what stood there then
        must not have merged earlier. Of equal merges the left one is made first.
        """
        while True:
            if self.merged.get((a, b), before) < before:
                return False
            if a > b:
                if a < 256:
                    return True
                before, a = a, self.right[a]
            else:
                if b < 256:
                    return True
                before, b = b + 1, self.left[b]

    def _fits(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= self.PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self._compatible(a, b)
        return known

    def encode_piece(self, piece: bytes) -> bytes:
        """Packed ids of bytes that no split divides."""
        chars = piece.decode("latin-1")
        if (whole := self.index.get(chars)) is not None:
            return self.packed[whole]
        size, shorter, fits = self.size, self.shorter, self._fits
        longest = [0] * len(chars)
        for last, token in self.automaton.iter(chars):
            longest[last + 1 - size[token]] = token
        dead, stack, at, token = bytearray(len(chars) + 1), [], 0, longest[0]
        while at < len(chars):
            end = at + size[token]
            if not dead[end] and (not stack or fits(stack[-1], token)):
                stack.append(token)
                at = end
                token = longest[at] if at < len(chars) else 0
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead[at] = 1
                token = stack.pop()
                at -= size[token]
        return b"".join([self.packed[t] for t in stack])

    def _plain(self, text: str) -> bytes:
        pieces = (self.split_ascii if text.isascii() else self.split).findall(text)
        return b"".join(map(self.cache.__getitem__, pieces))

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; added tokens' strings become those tokens."""
        if not text:
            return b""
        if self.split_added is None or not self.split_added.search(text):
            return self._plain(text)
        out, at = [], 0
        for found in self.split_added.finditer(text):
            out += [self._plain(text[at : found.start()]), self.added[found.group()].to_bytes(4, "little")]
            at = found.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become replacement characters."""
        found, out = np.frombuffer(ids, "<u4").astype(np.int64), []
        for i in range(0, len(found), 1 << 16):
            part = found[i : i + (1 << 16)]
            sizes = self.offsets[part + 1] - self.offsets[part]
            ends = np.cumsum(sizes)
            out.append(self.blob[np.repeat(self.offsets[part] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes())
        return b"".join(out).decode("utf-8", "replace")


class _Cache(dict):
    """Packed ids of pieces met before. When full it becomes the older generation, from which what is met again is taken over."""

    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe, self.older = bpe, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.bpe.CACHE:
            self.older = dict(self)
            self.clear()
        if (packed := self.older.get(piece)) is None:
            packed = self.bpe.encode_piece(piece.encode())
        if len(piece) < 64:
            self[piece] = packed
        return packed


_READY: dict[str, ByteBpe] = {}


def ready(source: bytes) -> ByteBpe:
    """The encoder of a vocabulary, built once a process."""
    key = hashlib.sha1(source).hexdigest()
    if key not in _READY:
        _READY[key] = ByteBpe(source)
    return _READY[key]


def encoded(docs: DataFrame, vocabulary: str, text_col: str = "text", packed: bool = False, decoded: str | None = None) -> DataFrame:
    """Documents with the columns ids and n_tokens (long), and the decoded text under the given name.

    vocabulary is a file on the driver; its bytes (about 1.5 MB, whatever the data) go to the executors.
    ids is an array of integers or, packed, little-endian unsigned 32-bit integers in a binary.
    """
    with open(vocabulary, "rb") as file:
        source = docs.sparkSession.sparkContext.broadcast(file.read())
    new = ["ids", "n_tokens", *([decoded] if decoded else [])]
    kept = [c for c in docs.columns if c not in new]
    place = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ready(source.value)
        for batch in by_size(batches, place, 2 << 20):
            found = [bpe.encode(t.as_py()) for t in batch.column(place)]
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
            if packed:
                ids = pa.array(found, pa.binary())
            else:
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
            more = [pa.array(map(bpe.decode, found), pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array(sizes), *more], [*kept, *new])

    kinds = [BinaryType() if packed else ArrayType(IntegerType()), LongType(), StringType()]
    return mapped(docs.select(*map(column, kept)), run, widened(docs, kept, dict(zip(new, kinds))))


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = encoded(docs, public_tokenizers.path("byte_bpe_50k.json"), packed=True, decoded="decoded")
    return found.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
