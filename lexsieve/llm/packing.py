"""Harmonic packing of tokenized documents into sequences of fixed length.

Each worker packs what it reads, without a shuffle. A document's remainder of
length r goes to class k = floor(capacity / r), whose bins hold exactly k pieces:
k pieces of at most capacity / k always fit. A bin that has its k pieces is topped up from one document that is cut freely, so full bins have no padding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lexsieve.llm.common import give_back, released, table

SCHEMA = T.StructType(
    [
        T.StructField(x, T.LongType())
        for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    ]
)
#: Characters of text tokenized and words remembered at a time, per worker.
SLICE_CHARS, CACHE_WORDS = 4_000_000, 400_000
LONG_WORD = 256
#: Sequence ids of one partition.
IDS_PER_PARTITION = 1 << 33


class WordEncoder:
    """Byte-level BPE ids of a text as little-endian 32-bit bytes, remembered word by word.

    A text may be cut before a space that follows no white space: no pre-token
    crosses such a place. Other texts are encoded whole, and those that hold
    special tokens by the tokenizers library itself, whose ids all of these equal.
    """

    def __init__(self, name: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(name))
        self.whole.no_truncation()
        self.whole.no_padding()
        alphabet = byte_alphabet()
        added = {x.content for x in self.whole.get_added_tokens_decoder().values()}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in self.whole.get_vocab().items() if t not in added}
        self.plain = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.blank_then_space = re.compile(r"\s ")
        self.words: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if self.special.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if self.blank_then_space.search(text):
            return self._ids(text)
        first, *rest = text.split(" ")
        words = self.words
        for word in set(rest).difference(words):
            words[word] = self._ids(" " + word)
        out = self._ids(first) + b"".join(map(words.__getitem__, rest))
        if len(text) > LONG_WORD:  # long words are not remembered, so the bound holds in bytes too
            for word in {x for x in rest if len(x) > LONG_WORD}:
                del words[word]
        if len(words) > CACHE_WORDS:
            words.clear()
        return out

    def _ids(self, text: str) -> bytes:
        return np.array(self.plain.encode_ordinary(text), dtype="<u4").tobytes()


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of the byte-level alphabet: printable bytes stand for themselves,
    the others for the code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass(slots=True)
class Piece:
    doc_id: int | None
    start: int
    total: int
    ids: bytes

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        """Its first n ids and the others."""
        return (
            Piece(self.doc_id, self.start, self.total, self.ids[: 4 * n]),
            Piece(self.doc_id, self.start + n, self.total, self.ids[4 * n :]),
        )


class HarmonicPacker:
    """Packs pieces in the order in which they come; holds at most one open bin a class,
    closed bins that wait for filling, and one document to fill with."""

    def __init__(self, capacity: int, first_id: int) -> None:
        if capacity < 1 or capacity & (capacity - 1):
            raise ValueError("capacity must be a power of two")
        self.capacity, self.next_id = capacity, first_id
        self.bins: dict[int, list[Piece]] = {}
        self.waiting: list[list[Piece]] = []
        self.filler: Piece | None = None
        self.rows: list[tuple] = []

    def add(self, document: Piece) -> None:
        if self.filler is None:
            self.filler = document
            self._top_up()
            return
        while len(document) > self.capacity:
            full, document = document.cut(self.capacity)
            self._emit([full])
        if not len(document):
            return
        k = self.capacity // len(document)
        bin_ = self.bins.setdefault(k, [])
        bin_.append(document)
        if len(bin_) == k:
            del self.bins[k]
            self.waiting.append(bin_)
            self._top_up()

    def finish(self) -> None:
        """Cuts what is left into full sequences and the last into lengths of powers of two."""
        rest = [*self.waiting, *self.bins.values(), [self.filler] if self.filler is not None else []]
        row: list[Piece] = []
        room = self.capacity
        for piece in (p for bin_ in rest for p in bin_):
            while len(piece):
                part, piece = piece.cut(min(room, len(piece)))
                row.append(part)
                room -= len(part)
                if not room:
                    self._emit(row)
                    row, room = [], self.capacity
        used, size = self.capacity - room, self.capacity
        while used:
            size //= 2
            if used & size:
                out, need = [], size
                while need:
                    part, left = row[0].cut(min(need, len(row[0])))
                    out.append(part)
                    need -= len(part)
                    row[:1] = [left] if len(left) else []
                self._emit(out)
                used -= size
        self.bins, self.waiting, self.filler = {}, [], None

    def _top_up(self) -> None:
        while self.waiting and self.filler is not None:
            bin_ = self.waiting[-1]
            gap = self.capacity - sum(map(len, bin_))
            part, left = self.filler.cut(min(gap, len(self.filler)))
            if len(part):
                bin_.append(part)
            self.filler = left if len(left) else None
            if len(part) == gap:
                self._emit(self.waiting.pop())

    def _emit(self, pieces: list[Piece]) -> None:
        offset = 0
        for p in pieces:
            self.rows.append((p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.total, self.next_id, offset))
            offset += len(p)
        self.next_id += 1


def pack_documents(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = 2048, end_id: int = 1
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs has doc_id and text; other columns are ignored. A null or empty text is the end id
    alone. Repeated rows are packed each. Every partition is packed on its own in
    the order of its rows, so a lost task gives the same rows again. Padding: none,
    as sequences are full or, up to log2(capacity) a partition, as long as a power of two.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        give_back()  # what reading the tokenizer took
        packer = HarmonicPacker(capacity, TaskContext.get().partitionId() * IDS_PER_PARTITION)
        end = np.array([end_id], dtype="<u4").tobytes()
        chars = 0

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [[]] * len(SCHEMA)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], SCHEMA.names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                packer.add(Piece(doc_id.as_py(), 0, len(ids) // 4, ids))
                chars += len(ids)
                if chars > SLICE_CHARS:
                    chars = 0
                    yield flushed()
        packer.finish()
        yield flushed()

    return docs.select("doc_id", "text").mapInArrow(released(pack), SCHEMA)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
