"""N-gram Jaccard join: a blocked sparse product of document-by-n-gram incidence.

Rows of the incidence are distinct n-gram sets (copies share a row), its columns n-grams in order of
rarity. The product is formed block by block: first over each row's leading columns, which any pair at
threshold t must meet in (the rarest n - ceil(t n) + 1 of a row), then over all columns for the rows that met, where a
pair is discarded as soon as its count and what is left of the rows fall below its least overlap.

A column of m rows is never multiplied out. Rows meet one hub a column; those that link
fall into one component, and later blocks meet across components only. In the last block rows of a column that have the
same component, size and bound are one class, and only classes within each other's bounds meet.
Links are exact and so are components.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from lexsieve.llm.common import BLANK, Written, checkpoint, released, table, text_bytes
from lexsieve.llm.phrase_fingerprint import MULTIPLIER, mix, powers

#: Bytes of text cut into shingles at a time, per worker; a longer text is cut alone.
SLICE_BYTES = 250_000
#: Pieces that a bounded array is dealt into, and how many arrays one task adds up.
CHUNKS, FAN = 16, 64
#: Columns of two rows that are multiplied before their bound is looked at.
BLOCK = 1024


@dataclass(frozen=True)
class Join:
    """Sets of n-word shingles link when
    whole * |x & y| >= part * |x | y|.

    sketch_bits: log2 of the counters that rank n-grams by rarity, or none: one for about 128 bytes of
    input, 2^24 at most. Any ranking gives the same links; a better one gives fewer candidates.
    hub_rounds: rounds against one hub a column before classes meet. hot: counted uses from which
    a column is dealt to several tasks.
    """

    n: int = 3
    part: int = 90
    whole: int = 100
    sketch_bits: int | None = None
    hub_rounds: int = 2
    hot: int = 10_000


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z lower-cased, and where each text's begin (and the end)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    fold = np.arange(256, dtype=np.uint8)
    fold[0x41:0x5B] += 0x20
    blank = np.zeros(256, dtype=bool)
    blank[[0x20, *range(9, 14)]] = True
    space = blank[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    begins, ends = edge[::2], edge[1::2]
    up, down = powers(1 << max(18, (len(data) - 1).bit_length()))
    values = mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)[fold][data]
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(data)], out=total[1:])
    hashes = mix((total[ends] - total[begins]) * down[begins] + mix((ends - begins).astype(np.uint64)))
    lengths = np.array([len(t) + 1 for t in texts])
    limits = np.concatenate([[0], np.cumsum(lengths)])
    return hashes, np.searchsorted(begins, limits)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Per text the ascending hashes of its distinct n-word shingles; all words as one if they are fewer."""
    words, at = word_hashes(texts)
    factors = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    size = max(0, len(words) - n + 1)
    grams = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        grams += words[k : k + size] * factors[k]
    grams = mix(grams)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            whole = (words[a:b] * factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([whole], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signature(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    a = mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    b = mix(grams + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    keys, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            keys.append(key)
            texts.append((text.as_py() or "").encode())
            size += len(texts[-1])
            if size >= SLICE_BYTES:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def batch_of(schema: T.StructType, columns: list) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(columns, schema, strict=True)],
        schema.names,
    )


PIECE = [T.StructField("task", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("data", T.BinaryType())]


def pieces(values: np.ndarray) -> list[list]:
    """task, chunk, data of an array."""
    pack = zstandard.ZstdCompressor(1).compress
    return [[TaskContext.get().partitionId()] * CHUNKS, list(range(CHUNKS)), [pack(x.tobytes()) for x in np.split(values, CHUNKS)]]


def merged(rows: DataFrame, tasks: int, combine: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """One array from the pieces() of this many tasks: added up chunk by chunk on the executors, FAN of them
    in a task, and joined on the driver. Its size is fixed by the caller, whatever the input."""
    schema = T.StructType(PIECE)

    def fold(found: pa.Table) -> pa.Table:
        total = None
        for data in found.column("data"):
            own = np.frombuffer(zstandard.decompress(data.as_py()), dtype=kind)
            total = own.copy() if total is None else combine(total, own)
        first = [found.column(c)[0].as_py() for c in ("task", "chunk")]
        return pa.Table.from_batches([batch_of(schema, [[first[0] // FAN], [first[1]], [zstandard.ZstdCompressor(1).compress(total.tobytes())]])])

    while True:
        rows = rows.groupBy("chunk", F.floor(F.col("task") / FAN).alias("few")).applyInArrow(fold, schema)
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            break
    found = {r["chunk"]: np.frombuffer(zstandard.decompress(r["data"]), dtype=kind) for r in rows.select("chunk", "data").collect()}
    return np.concatenate([found[k] for k in sorted(found)]) if found else np.zeros(CHUNKS, dtype=kind)


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums that stop at the largest 16-bit number."""
    return np.where(a > np.uint16(65535) - b, np.uint16(65535), a + b).astype(np.uint16)


NODE = [T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType())]


def _sets(docs: DataFrame, how: Join, written: Written) -> tuple[DataFrame, np.ndarray]:
    """doc_id, n, s1, s2 of every row (n = 0: no set), and the counters by n-gram hash."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.IntegerType()), *NODE, *PIECE])
    bits = how.sketch_bits or min(24, max(16, (text_bytes(docs) // 128).bit_length()))
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, dtype=np.uint32)
        for keys, texts in slices(batches):
            sets = shingle_sets(texts, how.n)
            np.add.at(counts, (np.concatenate(sets) & np.uint64(size - 1)).astype(np.int64), 1)
            marks = [signature(g) for g in sets]
            none = [None] * len(keys)
            yield batch_of(schema, [keys, [len(g) for g in sets], [m[0] for m in marks], [m[1] for m in marks], none, none, none])
        none = [None] * CHUNKS
        yield batch_of(schema, [none, none, none, none, *pieces(np.minimum(counts, 65535).astype(np.uint16))])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written.table(texts.mapInArrow(released(run), schema))
    counts = merged(rows.filter("chunk is not null").select("task", "chunk", "data"), docs.rdd.getNumPartitions(), added, "uint16")
    return rows.filter("chunk is null").select("doc_id", "n", "s1", "s2"), counts


def _columns(docs: DataFrame, sketch: np.ndarray, how: Join) -> DataFrame:
    """gram, salt, s1, s2, n, pos: the incidence of each distinct set over its leading n-grams. salt deals the rows
    of a column with many counted uses to several tasks; 0 for the others."""
    schema = T.StructType([T.StructField("gram", T.LongType()), T.StructField("salt", T.IntegerType()), *NODE, T.StructField("n", T.IntegerType()), T.StructField("pos", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        mask = np.uint64(len(rarity) - 1)
        seen: set[tuple[int, int]] = set()
        for _, texts in slices(batches):
            grams, uses, nodes, sizes, places = [], [], [], [], []
            for g in shingle_sets(texts, how.n):
                if not len(g) or (mark := signature(g)) in seen:
                    continue
                seen.add(mark)
                keep = len(g) - -(-how.part * len(g) // how.whole) + 1
                own = rarity[(g & mask).astype(np.int64)]
                order = np.argsort(own, kind="stable")[:keep]
                grams.append(g[order])
                uses.append(own[order])
                nodes.append(mark)
                sizes.append(len(g))
                places.append(keep)
            if grams:
                times = np.array(places)
                first = np.repeat(np.array([m[0] for m in nodes]), times)
                deals = np.concatenate(uses).astype(np.uint64) // np.uint64(how.hot)
                salt = np.where(deals > 0, mix(first.view(np.uint64)) % (deals + np.uint64(1)) + np.uint64(1), 0)
                yield batch_of(
                    schema,
                    [
                        pa.array(np.concatenate(grams).view(np.int64)),
                        pa.array(salt.astype(np.int32)),
                        pa.array(first),
                        pa.array(np.repeat(np.array([m[1] for m in nodes]), times)),
                        pa.array(np.repeat(sizes, times).astype(np.int32)),
                        pa.array(np.concatenate([np.arange(k) for k in places]).astype(np.int32)),
                    ],
                )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(released(run), schema)


def _slots(ids: pa.Array, bits: int) -> np.ndarray:
    """Where a bitmap holds these ids; a null id counts as 0."""
    values = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return (mix(values + np.uint64(1)) >> np.uint64(64 - bits)).astype(np.int64)


def _held(bitmap: np.ndarray, ids: pa.Array, bits: int) -> np.ndarray:
    at = _slots(ids.cast(pa.int64()), bits)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def _bitmap(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A packed bitmap of a column of ids and log2 of its size: about 16 bits an id, 2^28 in all at most."""
    bits = min(28, max(16, (16 * ids.count()).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << bits, dtype=bool)
        for batch in batches:
            found[_slots(batch.column(0), bits)] = True
        yield batch_of(T.StructType(PIECE), pieces(np.packbits(found)))

    rows = ids.mapInArrow(released(mark), T.StructType(PIECE))
    return merged(rows, rows.rdd.getNumPartitions(), np.bitwise_or, "uint8"), bits


def _full_rows(docs: DataFrame, wanted: DataFrame, how: Join) -> DataFrame:
    """s1, s2, grams of the distinct sets of the documents wanted (id), and of some others: a bitmap of the ids
    keeps most other texts from being cut into shingles."""
    bitmap, bits = _bitmap(wanted)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    schema = T.StructType([*NODE, T.StructField("grams", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        few = (batch.filter(pa.array(_held(shared.value, batch.column(0), bits))) for batch in batches)
        for _, texts in slices(few):
            sets, nodes = [], []
            for g in shingle_sets(texts, how.n):
                if len(g) and (m := signature(g)) not in seen:
                    seen.add(m)
                    sets.append(g)
                    nodes.append(m)
            if sets:
                offsets = np.concatenate([[0], np.cumsum([len(g) for g in sets])]).astype(np.int32)
                values = pa.array(np.concatenate(sets).view(np.int64))
                item = pa.field("element", pa.int64(), nullable=False)
                lists = pa.ListArray.from_arrays(pa.array(offsets), values, type=pa.list_(item))
                yield batch_of(schema, [[m[0] for m in nodes], [m[1] for m in nodes], lists])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(run), schema)
    return rows.dropDuplicates(["s1", "s2"])


def overlap(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """How many columns two rows share (each ascending), counted block by block; -1 as soon as fewer than least can be."""
    if len(a) > len(b):
        a, b = b, a
    count = 0
    for at in range(0, len(a), BLOCK):
        block = a[at : at + BLOCK]
        if count + len(a) - at < least:
            return -1
        place = np.searchsorted(b, block)
        place[place == len(b)] = 0
        count += int((b[place] == block).sum())
    return count if count >= least else -1


def _most(n: Column | str, pos: Column | str, how: Join) -> Column:
    """The largest set that a row of n columns can link with, if the first column they share is its pos-th."""
    return F.expr(f"int((({n} - {pos}) * {how.whole + how.part}L) div {how.part} - {n})")


def _linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, how: Join, written: Written) -> DataFrame:
    """u, v of the pairs (u, v) whose overlap over all columns reaches the threshold. u is the hub, whose row meets many."""

    def ends(name: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("s1", "s2", "id")])

    named = written.table(pairs.join(ends("u"), "u").join(ends("v"), "v"))
    wanted = written.table(named.select(F.col("u_id").alias("id")).union(named.select("v_id")).distinct())
    rows = written.table(_full_rows(docs, wanted, how))

    def row(name: str) -> DataFrame:
        return rows.select(F.col("s1").alias(f"{name}_s1"), F.col("s2").alias(f"{name}_s2"), F.col("grams").alias(f"{name}_grams"))

    both = (
        named.drop("u_id", "v_id")
        .join(row("v"), ["v_s1", "v_s2"])
        .select("u", "v", "u_s1", "u_s2", "v_grams")
        .join(row("u"), ["u_s1", "u_s2"])
        .select("u", "v", "u_grams", "v_grams")
    )
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("u_grams"), batch.column("v_grams")
            keep = []
            for a, b in zip(x, y, strict=True):
                a, b = (g.values.to_numpy().view(np.uint64) for g in (a, b))
                least = -(-how.part * (len(a) + len(b)) // (how.part + how.whole))
                keep.append(overlap(a, b, least) >= 0)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    links = written.table(both.mapInArrow(released(run), schema))
    written.drop(named, wanted, rows)
    return links


def components(links: DataFrame) -> DataFrame:
    """id, component (least id reachable) for the ids of links (u, v): least labels with pointer jumping."""
    edges = checkpoint(links.select("u", "v").union(links.select("v", "u")).distinct())
    labels = checkpoint(edges.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("component")))
    while True:
        heard = (
            edges.join(labels.withColumnRenamed("id", "v"), "v")
            .groupBy(F.col("u").alias("id"))
            .agg(F.min("component").alias("heard"))
        )
        lower = labels.join(heard, "id").select(
            "id", F.least("component", "heard").alias("next"), F.col("component").alias("was")
        )
        up = labels.select(F.col("id").alias("next"), F.col("component").alias("root"))
        after = checkpoint(
            lower.join(up, "next", "left").select(
                "id", F.least("next", "root").alias("component"), "was"
            )
        )
        labels = after.select("id", "component")
        if after.filter("component < was").isEmpty():
            return labels


def _labelled(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    """entries with the component of their node; a node without links is its own."""
    if labels is None:
        return entries.withColumn("component", F.col("node"))
    own = labels.select(F.col("id").alias("node"), "component")
    return entries.join(own, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _hubs(entries: DataFrame, how: Join, written: Written) -> tuple[DataFrame, DataFrame]:
    """Pairs (u: a column's hub, v) within their bounds, and the entries but the hubs of all columns that
    still hold two components. The hub has the fewest rarer columns of its own, so most others are near it."""
    hubs = written.table(
        entries.groupBy("gram")
        .agg(F.min(F.struct("pos", "n", "node", "component")).alias("hub"), F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low < high")
        .select("gram", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("pos", "n", "node", "component")])
    )
    met = written.table(entries.join(hubs, "gram").filter("node != hub_node"))
    written.drop(hubs)
    fits = (F.col("hub_component") != F.col("component")) & (F.col("hub_n") <= _most("n", "pos", how)) & (F.col("n") <= _most("hub_n", "hub_pos", how))
    return met.filter(fits).select(F.col("hub_node").alias("u"), F.col("node").alias("v")).distinct(), met


def _classes(entries: DataFrame, how: Join, written: Written) -> DataFrame:
    """Pairs (u, v) of all entries of a column that lie in two components and within each other's bounds."""
    entries = written.table(entries.withColumn("most", _most("n", "pos", how)))
    key = ["gram", "component", "n", "most"]
    classes = written.table(entries.groupBy(*key).agg(F.count("*").alias("rows")))

    def band(size: str) -> Column:
        # Sets that link are less than two bands apart.
        return F.floor(F.log(F.col(size).cast("double")) / float(np.log(how.whole / how.part) + 1e-9)).cast("int")

    def side(name: str) -> list[Column]:
        return [F.col(c).alias(f"{name}_{c}") for c in key[1:]]

    # The smaller set of a pair must itself be within the other's reach at its own size.
    small = classes.filter("most >= n").select("gram", F.explode(F.sequence(band("n"), band("most"))).alias("band"), *side("u"))
    large = classes.select("gram", band("n").alias("band"), *side("v"))
    fits = "u_component != v_component and u_n <= v_n and v_n <= u_most and u_n <= v_most and (u_n < v_n or u_component < v_component)"
    met = written.table(small.join(large, ["gram", "band"]).filter(fits).drop("band"))

    def rows(name: str) -> DataFrame:
        return entries.select("gram", F.col("node").alias(name), *side(name))

    pairs = met.join(rows("u"), ["gram", *[f"u_{c}" for c in key[1:]]]).join(rows("v"), ["gram", *[f"v_{c}" for c in key[1:]]])
    return pairs.select("u", "v").distinct()


def _joined(docs: DataFrame, how: Join) -> tuple[DataFrame, DataFrame]:
    """sets (doc_id, n, s1, s2 of every row) and nodes (s1, s2, node, component) of the distinct sets."""
    written = Written(docs.sparkSession)
    sets, sketch = _sets(docs, how, written)
    found = sets.filter("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("id"))
    nodes = written.table(found.withColumn("node", F.monotonically_increasing_id()))
    # Copies read by several tasks give equal rows: one is kept. One shuffle serves both steps.
    shared = (
        _columns(docs, sketch, how)
        .repartition(F.col("gram"), F.col("salt"))
        .groupBy("gram", "salt", "s1", "s2")
        .agg(F.first("n").alias("n"), F.first("pos").alias("pos"))
        .withColumn("many", F.count("*").over(Window.partitionBy("gram", "salt")))
        .filter("many > 1 or salt > 0")
    )
    entries = written.table(shared.join(nodes.drop("id"), ["s1", "s2"]).select("gram", "node", "n", "pos"))
    links, labels, read = None, None, entries
    for turn in range(how.hub_rounds + 1):
        open_ = _labelled(entries, labels)
        if turn < how.hub_rounds:
            pairs, met = _hubs(open_, how, written)
        else:
            pairs, met = _classes(open_, how, written), entries
        pairs = written.table(pairs)
        if not pairs.isEmpty():
            fresh = _linked(pairs, nodes, docs, how, written)
            links = fresh if links is None else links.union(fresh)
            labels = components(links)
        written.drop(read, pairs)
        entries, read = met.select("gram", "node", "n", "pos"), met
        if turn < how.hub_rounds and met.isEmpty():
            break
    return sets, _labelled(nodes, labels)


def join_components(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text); other columns are ignored.

    component_id is the least doc_id reachable by links, itself included. A null,
    empty or blank text has no shingles and links with nothing. Repeated rows and copies
    share a set and so a component. Rows without a doc_id link like others; only a component that
    has no doc_id at all has a null one. A text of any length is one row. An empty table gives no rows. No set of
    all links, components or documents comes to the driver; broadcasts are the
    counters (2 bytes each) and a bitmap (32 MB at most).
    """
    sets, nodes = _joined(docs, how)
    # Written, so that the join with a component of many sets can be split.
    least = Written(docs.sparkSession).table(nodes.groupBy("component").agg(F.min("id").alias("component_id")))
    home = nodes.join(least, "component").select("s1", "s2", "component_id")
    return sets.join(home, ["s1", "s2"], "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """The rows of docs (doc_id, text and any others) without all but one of each component: the one of the least
    doc_id stays, the last being none; among rows of one doc_id that of the least signature, and among
    equal rows any one. Rows without a set all stay. Only rows that may go are shuffled with their text.
    An empty table gives none.
    """
    sets, nodes = _joined(docs, how)
    written = Written(docs.sparkSession)
    rows = sets.filter("n > 0").groupBy("doc_id", "s1", "s2").agg(F.count("*").alias("times"))
    rows = written.table(rows.join(nodes.select("s1", "s2", "component"), ["s1", "s2"]))
    chosen = rows.groupBy("component").agg(F.min(F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", "s1", "s2")).alias("first"))
    chosen = written.table(chosen)
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("s1") == F.col("first.s1")) & (F.col("s2") == F.col("first.s2"))
    judged = written.table(rows.join(chosen, "component").select("doc_id", "s1", "s2", "times", same.alias("stays")))
    bitmap, bits = _bitmap(judged.filter("not stays or times > 1").select("doc_id"))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    @F.arrow_udf("boolean")
    def in_doubt(ids: pa.Array) -> pa.Array:
        return pa.array(_held(shared.value, ids, bits))

    names = [f"_{c}_{uuid.uuid4().hex}" for c in ("s1", "s2", "n")]
    schema = T.StructType([*docs.schema, *[T.StructField(c, T.LongType()) for c in names]])
    key, text = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            few = batch.filter(pa.array(_held(shared.value, batch.column(key), bits)))
            found = [shingle_sets([(t.as_py() or "").encode()], how.n)[0] for t in few.column(text)]
            marks = [signature(g) for g in found]
            more = [pa.array(c, pa.int64()) for c in ([m[0] for m in marks], [m[1] for m in marks], [len(g) for g in found])]
            yield pa.RecordBatch.from_arrays([*few.columns, *more], schema.names)

    # One Python worker a task: the rows in doubt are found and signed by one function, the others by another.
    signed = docs.mapInArrow(released(run), schema)
    verdict = judged.filter("stays").select(F.col("doc_id").alias("_id"), F.col("s1").alias("_s1"), F.col("s2").alias("_s2"))
    alike = signed["doc_id"].eqNullSafe(verdict["_id"]) & (signed[names[0]] == verdict["_s1"]) & (signed[names[1]] == verdict["_s2"])
    stays = signed.filter(F.col(names[2]) > 0).join(verdict, alike, "left_semi").dropDuplicates(["doc_id", *names[:2]])
    bare = signed.filter(F.col(names[2]) == 0)
    return docs.filter(~in_doubt(docs["doc_id"].cast("long"))).unionByName(stays.drop(*names)).unionByName(bare.drop(*names))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))


def oracle_sql(how: Join = Join()) -> str:
    """DuckDB SQL for op7: shingles as words, full overlaps by joins, components by recursion."""
    last = how.n - 1
    keep = f"{{0}}.n - ceil({how.part} * {{0}}.n / {how.whole}.0) + 1".format
    return rf"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{BLANK}]+'), lambda w: w <> '') AS ws
  FROM documents
), g AS (
  SELECT DISTINCT k, array_to_string(CASE WHEN len(ws) < {how.n} THEN ws ELSE ws[i : i + {last}] END, ' ') AS gram
  FROM (SELECT k, ws, unnest(range(1, greatest(len(ws) - {last}, 1) + 1)) AS i FROM t WHERE len(ws) > 0)
), n AS MATERIALIZED (SELECT k, count(*) AS n FROM g GROUP BY k),
u AS (SELECT gram, count(*) AS c FROM g GROUP BY gram),
p AS MATERIALIZED (SELECT g.k, gram, n, row_number() OVER (PARTITION BY g.k ORDER BY c, gram) AS pos FROM g JOIN n USING (k) JOIN u USING (gram)),
pair AS (
  SELECT DISTINCT a.k AS a, b.k AS b, a.n + b.n AS total FROM p a JOIN p b USING (gram)
  WHERE a.k < b.k AND a.pos <= {keep('a')} AND b.pos <= {keep('b')} AND {how.whole} * least(a.n, b.n) >= {how.part} * greatest(a.n, b.n)
), link AS (
  SELECT a, b FROM (SELECT a, b, any_value(total) AS total, count(*) AS met FROM pair JOIN g x ON x.k = a JOIN g y ON y.k = b AND y.gram = x.gram GROUP BY a, b)
  WHERE {how.whole} * met >= {how.part} * (total - met)
), edge AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(k, r) AS (SELECT k, k FROM t UNION SELECT reach.k, edge.b FROM reach JOIN edge ON edge.a = reach.r)
SELECT t.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM t JOIN reach USING (k) JOIN t o ON o.k = reach.r LEFT JOIN n ON n.k = t.k GROUP BY t.k, t.doc_id
"""


OP7_SQL = oracle_sql()
