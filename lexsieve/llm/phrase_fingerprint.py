"""Document fingerprints by locally consistent parsing.

Deterministic coin tossing cuts a text into phrases at places that depend on a few
neighbouring symbols only; phrases get names by content, and the names are parsed again.
So equal substrings share the names of their interior phrases wherever they lie. A
fingerprint keeps the smallest names of one level; all of it works on whole arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexsieve.llm.common import table

#: Bytes of text parsed at a time, per worker; a longer text is parsed alone.
SLICE_BYTES = 2_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
LOWEST = -(2**63)
#: Tables by their size, made once a worker.
TOSSES: dict[int, tuple[np.ndarray, int]] = {}
POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


@dataclass(frozen=True)
class Parsing:
    """level: how often names are parsed again (phrases grow about threefold each time);
    keep: how many of the smallest names a fingerprint holds."""

    level: int = 3
    keep: int = 64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def toss_table(size: int) -> tuple[np.ndarray, int]:
    """Flat table of the label of symbol b after symbol a, by a * size + b, and how many
    labels there are. The last label is for equal neighbours."""
    if size in TOSSES:
        return TOSSES[size]
    a, b = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    differ = a ^ b
    low = np.where(differ > 0, np.bitwise_count((differ & -differ) - 1), 0)
    label = 2 * low + (b >> low & 1)
    equal = int(label.max()) + 1
    TOSSES[size] = np.where(differ > 0, label, equal).astype(np.uint8).ravel(), equal + 1
    return TOSSES[size]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """MULTIPLIER ** i and its inverse modulo 2 ** 64."""
    if size in POWERS:
        return POWERS[size]
    inverse = np.uint64(pow(int(MULTIPLIER), -1, 2**64))
    out = []
    for base in (MULTIPLIER, inverse):
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    POWERS.clear()
    POWERS[size] = out[0], out[1]
    return POWERS[size]


def shifted(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The left neighbours; 0 at the starts."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[starts] = 0
    return out


def relabel(labels: np.ndarray, count: int, starts: np.ndarray) -> tuple[np.ndarray, int]:
    """One more toss over labels below count."""
    found, then = toss_table(count)
    return found[shifted(labels, starts).astype(np.uint16) * np.uint16(count) + labels], then


def cuts(labels: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where phrases begin: at local maxima of the labels and at the starts."""
    right = np.empty_like(labels)
    right[:-1] = labels[1:]
    right[-1] = 0
    right[starts[1:] - 1] = 0
    begins = (labels > shifted(labels, starts)) & (labels >= right)
    begins[starts] = True
    return np.flatnonzero(begins)


def named(symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A name for each phrase, from its symbols and its length."""
    size = len(symbols)
    up, down = powers(1 << max(20, (size - 1).bit_length()))
    total = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum(symbols * up[:size], out=total[1:])
    ends = np.append(begins[1:], size)
    return mix((total[ends] - total[begins]) * down[begins] + mix((ends - begins).astype(np.uint64)))


def parse(texts: list[bytes], level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of this level of all texts (none empty), and where each text's begin."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    starts = np.zeros(len(texts), dtype=np.int64)
    np.cumsum([len(t) for t in texts[:-1]], out=starts[1:])
    labels, count = relabel(data, 256, starts)
    labels, count = relabel(labels, count, starts)
    names = mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)[data]
    for _ in range(level):
        begins = cuts(labels, starts)
        names = named(names, begins)
        starts = np.searchsorted(begins, starts)
        left = shifted(names, starts)
        differ = names ^ left
        low = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) & np.uint8(63)
        labels = (2 * low + (names >> low.astype(np.uint64) & np.uint64(1)).astype(np.uint8)).astype(np.uint8)
        labels[differ == 0] = 128
        labels, count = relabel(labels, 129, starts)
        labels, count = relabel(labels, count, starts)
    return names, starts


def sketch(texts: list[bytes], how: Parsing) -> list[np.ndarray]:
    """Per text the smallest distinct names, ascending; nothing for an empty text."""
    filled = [i for i, t in enumerate(texts) if t]
    out = [np.zeros(0, dtype=np.uint64)] * len(texts)
    if not filled:
        return out
    names, starts = parse([texts[i] for i in filled], how.level)
    ends = np.append(starts[1:], len(names))
    owner = np.repeat(np.arange(len(starts)), ends - starts)
    order = np.lexsort((names, owner))
    names, owner = names[order], owner[order]
    new = np.ones(len(names), dtype=bool)
    new[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
    names, owner = names[new], owner[new]
    firsts = np.searchsorted(owner, np.arange(len(starts) + 1))
    for k, i in enumerate(filled):
        out[i] = names[firsts[k] : min(firsts[k + 1], firsts[k] + how.keep)]
    return out


def likeness(a: np.ndarray, b: np.ndarray, keep: int) -> float:
    """Share of common names among the smallest of both; 1 for two empty fingerprints."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    lowest = np.union1d(a, b)[:keep]
    return len(np.intersect1d(np.intersect1d(a, b, True), lowest, True)) / len(lowest)


def shown(names: np.ndarray) -> str:
    """A fingerprint as text: 16 hexadecimal digits a name."""
    return names.astype(">u8").tobytes().hex()


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def fingerprint_texts(docs: DataFrame, how: Parsing = Parsing()) -> DataFrame:
    """doc_id, fingerprint of every row of docs (doc_id, text); row by row, without a shuffle.

    Other columns are ignored. A null text counts as empty; an empty text has the
    empty fingerprint. Equal texts have equal fingerprints.
    """
    schema = T.StructType([SCHEMA["doc_id"], SCHEMA["fingerprint"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _slices(batches):
            found = [shown(x) for x in sketch([r[1].encode() for r in rows], how)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(found)], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    rows, size = [], 0
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            key, text, *rest = (x.as_py() for x in row)
            rows.append((key, text or "", *rest))
            size += len(rows[-1][1])
            if size >= SLICE_BYTES:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs (doc_id, text) dealt into ranges of doc_id, each sorted by descending doc_id
    with the row that follows its last one at its end (guest), and the number of ranges.

    Rows of one doc_id lie together in one range, ordered by text; a null doc_id is the smallest.
    Only ids are read to find the ranges; the driver gets two ids a range. Every text is
    shuffled once, the rows at the upper ends of ranges twice.
    """
    spark = docs.sparkSession
    n = max(1, docs.rdd.getNumPartitions())
    key = F.coalesce(F.col("doc_id"), F.lit(LOWEST))
    ids = docs.select(key.alias("key"))
    bounds = ids.select(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    edges = np.unique(np.array(bounds, dtype=np.int64))

    def range_of(keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(edges, keys, side="right")

    @F.pandas_udf("int")
    def own(keys: pd.Series) -> pd.Series:
        return pd.Series(range_of(keys.to_numpy()).astype(np.int32))

    tops = sorted(ids.groupBy(own("key").alias("part")).agg(F.max("key")).collect())
    # The first row of each range also closes the range above; the very first closes the lowest.
    guest_of = {top: above for (_, top), (above, _) in zip(tops, tops[1:] + tops[:1], strict=True)}

    @F.pandas_udf("array<int>")
    def places(keys: pd.Series) -> pd.Series:
        parts = range_of(keys.to_numpy()).tolist()
        return pd.Series([[p] if (g := guest_of.get(k)) is None else [p, g] for p, k in zip(parts, keys.tolist(), strict=True)])

    dealt = docs.select("doc_id", "text", key.alias("key")).select(
        "doc_id", "text", "key", F.posexplode(places("key")).alias("guest", "part")
    )
    # The range's number is the partition: by its hash some would hold several ranges and some none.
    ordered = dealt.repartitionById(n, "part").sortWithinPartitions(
        "part", "guest", F.desc("key"), F.asc_nulls_first("text")
    )
    return ordered.select("doc_id", "text", "part", "guest"), n


def compare_with_next(docs: DataFrame, how: Parsing = Parsing()) -> DataFrame:
    """Fingerprints of every text of docs (doc_id, text) and of its edited form, and their likeness.

    The edited text takes the last half from the next document by descending doc_id
    (after the last: the first). Repeated rows each have a row; among rows of one doc_id the
    order is by text. One row is its own next; an empty table gives no rows.
    """
    rows = with_next(docs)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for fresh in _slices(batches):
            held += fresh
            yield compared(held)
            held = held[-1:]

    def compared(rows: list[tuple]) -> pa.RecordBatch:
        pairs = [(i, i + 1) for i in range(len(rows) - 1) if not rows[i][3] and rows[i][2] == rows[i + 1][2]]
        needed = sorted({i for pair in pairs for i in pair})
        edited = []
        for i, j in pairs:
            text, half = rows[i][1], len(rows[i][1]) // 2
            edited.append((text[: len(text) - half] + rows[j][1][:half]).encode())
        plain = dict(zip(needed, sketch([rows[i][1].encode() for i in needed], how), strict=True))
        changed = sketch(edited, how)
        columns = [
            [rows[i][0] for i, _ in pairs],
            [len(rows[i][1]) for i, _ in pairs],
            [hashlib.sha256(x).hexdigest() for x in edited],
            [shown(plain[i]) for i, _ in pairs],
            [shown(x) for x in changed],
            [likeness(plain[i], x, how.keep) for (i, _), x in zip(pairs, changed, strict=True)],
            [likeness(plain[i], plain[j], how.keep) for i, j in pairs],
        ]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], SCHEMA.names)

    return rows.mapInArrow(run, SCHEMA)


def op4_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
