"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a slice of a partition are encoded at once: every pair of
neighbouring symbols has a list of all its positions, and active ranks are applied in
ascending order, each to its whole list, while the lists of new pairs are updated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lexsieve.llm.common import table
from lexsieve.llm.packing import byte_alphabet

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)
#: Characters of text encoded together and chunks remembered, per worker.
SLICE_CHARS, CACHE_CHUNKS = 4_000_000, 300_000
#: Characters from which a chunk is forgotten after its slice.
LONG_CHUNK = 256
#: The tokenizer's pre-tokens, with its white space spelled out.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
#: Control characters that str.split takes for white space and the tokenizer does not.
ODD_BLANKS = re.compile("[\x1c-\x1f]")
WHITE = regex.compile(r"\p{White_Space}+")


class PairIndex:
    """Encodes words by merges: {(left id, right id): (rank, merged id)}."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]) -> None:
        self.merges = merges

    def encode(self, words: Iterable[list[int]]) -> list[list[int]]:
        symbols: list[int] = []
        starts = []
        for word in words:
            starts.append(len(symbols))
            symbols += word
            symbols.append(-1)  # ends a word: no pair holds it
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        merges, where, active = self.merges, {}, []

        def note(at: int, pair: tuple[int, int]) -> None:
            found = merges.get(pair)
            if found is not None:
                rank = found[0]
                if rank in where:
                    where[rank][2].append(at)
                else:
                    where[rank] = (pair, found[1], [at])
                    heapq.heappush(active, rank)

        for at, pair in enumerate(zip(symbols, symbols[1:])):
            note(at, pair)
        while active:
            (left, right), merged, places = where.pop(heapq.heappop(active))
            places.sort()
            for at in places:
                then = after[at]
                if symbols[at] != left or symbols[then] != right:
                    continue  # merged away meanwhile
                symbols[at], symbols[then] = merged, -2
                beyond = after[then]
                after[at], before[beyond] = beyond, at
                note(at, (merged, symbols[beyond]))
                if (prior := before[at]) >= 0:
                    note(prior, (symbols[prior], merged))
        out = []
        for start in starts:
            word = []
            while symbols[start] != -1:
                word.append(symbols[start])
                start = after[start]
            out.append(word)
        return out


class Codec:
    """A tokenizer file's encode and decode for BPE with word ends, without its engine.

    The file must have the shape of word_bpe_49k.json: NFC, white space and lower-case
    normalizers, PIECES as pre-tokens, byte alphabet, an end-of-word suffix, no decoder.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or spec.get("decoder") is not None or model.get("dropout"):
            raise ValueError(f"{path} is no BPE file with word ends and without a decoder")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None
        characters = {b: c for c, b in byte_alphabet().items()}
        self.inner = [vocab[characters[b]] for b in range(256)]
        self.final = [vocab[characters[b] + suffix] for b in range(256)]
        merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.index = PairIndex(merges)
        #: By id, in UTF-8; ids that the file skips are empty.
        self.spelt = [self.tokens.get(i, "").encode() for i in range(max(self.tokens) + 1)]
        #: White-space-free chunk -> its ids, as bytes.
        self.ids: dict[str, bytes] = {}
        self.long: list[str] = []

    def sections(self, text: str) -> list[tuple[str | None, list[str]]]:
        """Added tokens and the chunks of what lies between, in order."""
        parts = self.special.split(text) if self.special and "<" in text else [text]
        return [(p, []) if i % 2 else (None, self.chunks(p)) for i, p in enumerate(parts)]

    @staticmethod
    def chunks(text: str) -> list[str]:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # Character by character, so a capital sigma is never a final one.
        text = text.replace("Σ", "σ").lower()
        return [x for x in WHITE.split(text) if x] if ODD_BLANKS.search(text) else text.split()

    def learn(self, chunks: Iterable[str]) -> None:
        """Encodes the chunks not remembered, all together."""
        new = [c for c in dict.fromkeys(chunks) if c not in self.ids]
        pieces = [PIECES.findall(c) for c in new]
        words = list(dict.fromkeys(p for row in pieces for p in row))
        symbols = []
        for word in words:
            *head, last = word.encode()
            symbols.append([self.inner[b] for b in head] + [self.final[last]])
        known = dict(zip(words, self.index.encode(symbols), strict=True))
        for chunk, row in zip(new, pieces, strict=True):
            ids = [i for piece in row for i in known[piece]]
            self.ids[chunk] = np.array(ids, dtype="<u4").tobytes()
            if len(chunk) > LONG_CHUNK:
                self.long.append(chunk)

    def decode(self, ids: bytes) -> bytes:
        """The text (UTF-8) of ids (little-endian, 32 bits): without a decoder, tokens parted by spaces."""
        return b" ".join(map(self.spelt.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids (little-endian, 32 bits) of each text."""
        if len(self.ids) > CACHE_CHUNKS:
            self.ids.clear()
        split = [self.sections(t) for t in texts]
        self.learn(set().union(*(chunks for row in split for _, chunks in row)))
        for row in split:
            ids = []
            for token, chunks in row:
                if token is None:
                    ids += map(self.ids.__getitem__, chunks)
                else:
                    ids.append(np.array([self.added[token]], dtype="<u4").tobytes())
            yield b"".join(ids)
        # What is remembered has a bound in bytes too.
        for chunk in self.long:
            self.ids.pop(chunk, None)
        self.long.clear()


def slices(batches: Iterator[pa.RecordBatch], chars: int = SLICE_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Keys (column 0) and texts (column 1, null as empty) in slices of about this many characters."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            keys.append(key)
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= chars:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def encode_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs (doc_id, text).

    Other columns are ignored. A null or empty text has no ids and decodes to an empty
    text. Rows are independent: no shuffle, repeated rows give repeated results, an
    empty table none. A text of any length is encoded whole. Memory: one slice of texts (or one longer text) and a
    bounded cache a worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        codec = Codec(public_tokenizers.path(tokenizer))
        for keys, texts in slices(batches):
            counts, hashes, decoded = [], [], []
            for ids in codec.encode(texts):
                counts.append(len(ids) // 4)
                hashes.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(hashes), pa.array(decoded)],
                SCHEMA.names,
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
