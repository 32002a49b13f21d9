"""Quality classifier by positive-unlabelled learning.

A small network minimises the non-negative unbiased risk from trusted positives
and unlabelled texts; the share of positives among the unlabelled is estimated from
the scores of a first network, as the least ratio of their upper tails.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexsieve.llm.common import held_out, released, table

# Common words of four languages.
COMMON = frozenset(
    "the of and to in a is that it der die und den von zu das de la le et les des en un que el y los las".split()
)
#: Byte classes whose shares are features.
BYTE_CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b" \t\r\x0b\x0c",
    b"\n",
    b".,;",
    b"!?",
    b"|",
    b"#*$%&<>",
    b"\"'()[]{}=_/\\@:+-",
    bytes(range(0x80, 0x100)),
)
N_FEATURES = len(BYTE_CLASSES) + 9


@dataclass(frozen=True)
class Learning:
    """max_sample bounds the positives and the unlabelled texts that the network is fitted to
    (those with the smallest hashes of their ids); all rows are scored."""

    max_sample: int = 20_000
    hidden: int = 24
    epochs: int = 60
    batch: int = 500
    rate: float = 0.01
    seed: int = 7


def class_matrix() -> np.ndarray:
    out = np.zeros((256, len(BYTE_CLASSES)))
    for k, members in enumerate(BYTE_CLASSES):
        out[list(members), k] = 1
    return out


def features(text: str, classes: np.ndarray) -> np.ndarray:
    """Shares of byte classes, of repeated, common and commonest words, of repeated lines; lengths."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    out = np.zeros(N_FEATURES, dtype=np.float32)
    k = len(BYTE_CLASSES)
    if not len(data):
        return out
    out[:k] = np.bincount(data, minlength=256) @ classes / len(data)
    words = text.split()
    n = len(words)
    if n:
        uses = Counter(words)
        lines = [x for x in text.split("\n") if x.strip()]
        out[k:] = (
            np.log1p(n),
            len(text) / n,
            len(uses) / n,
            np.log1p(len(uses)) / np.log1p(n),
            max(uses.values()) / n,
            sum(map(eq, words, words[1:])) / n,
            sum(map(COMMON.__contains__, map(str.lower, words))) / n,
            1 - len(set(lines)) / len(lines),
            np.log1p(n / len(lines)),
        )
    return out


def feature_rows(texts: pa.Array, classes: np.ndarray) -> np.ndarray:
    """features() of these texts; a null text counts as empty."""
    return np.array([features(t.as_py() or "", classes) for t in texts], dtype=np.float64).reshape(-1, N_FEATURES)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Network:
    """One hidden layer; its output is a log-odds."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, hidden: int, seed: int) -> None:
        draw = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.weights = [
            draw.normal(0, 1 / np.sqrt(len(mean)), (len(mean), hidden)),
            np.zeros(hidden),
            draw.normal(0, 1 / np.sqrt(hidden), hidden),
            np.zeros(1),
        ]
        self.moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights]
        self.steps = 0

    def layers(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        h = np.tanh(z @ self.weights[0] + self.weights[1])
        return z, h, h @ self.weights[2] + self.weights[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.layers(x)[2])

    def descend(self, z: np.ndarray, h: np.ndarray, slope: np.ndarray, rate: float) -> None:
        """One Adam step; slope is the risk's derivative by each row's output."""
        back = np.outer(slope, self.weights[2]) * (1 - h * h)
        slopes = [z.T @ back, back.sum(0), h.T @ slope, np.array([slope.sum()])]
        self.steps += 1
        for w, g, (m, v) in zip(self.weights, slopes, self.moments, strict=True):
            g = g + 1e-4 * w
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)


def _fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, how: Learning) -> Network:
    """With a prior: non-negative risk. Without: positives against unlabelled."""
    both = np.concatenate([positive, unlabelled])
    net = Network(both.mean(0), both.std(0) + 1e-6, how.hidden, how.seed)
    draw = np.random.default_rng(how.seed + 1)
    rounds = max(1, max(len(positive), len(unlabelled)) // how.batch)
    for epoch in range(how.epochs):
        rate = how.rate * 0.5 * (1 + np.cos(np.pi * epoch / how.epochs))
        for _ in range(rounds):
            p = positive[draw.integers(len(positive), size=how.batch)]
            u = unlabelled[draw.integers(len(unlabelled), size=how.batch)]
            z, h, out = net.layers(np.concatenate([p, u]))
            right, n = sigmoid(out), how.batch
            slope = np.empty(2 * n)
            if prior is None:
                slope[:n], slope[n:] = (right[:n] - 1) / n, right[n:] / n
            else:
                # Logistic losses: of calling a row negative softplus(out), positive softplus(-out).
                negative = np.logaddexp(0, out)
                rest = negative[n:].mean() - prior * negative[:n].mean()
                if rest >= 0:
                    slope[:n] = prior * (right[:n] - 1) / n - prior * right[:n] / n
                    slope[n:] = right[n:] / n
                else:  # the unbiased part went below zero: step back from it
                    slope[:n], slope[n:] = prior * right[:n] / n, -right[n:] / n
            net.descend(z, h, slope, rate)
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.05) -> float:
    """Share of positives among the unlabelled, from scores: the least ratio of upper tails
    over all cuts, each with the sampling error that its counts allow."""
    cuts = np.unique(np.quantile(positive, np.linspace(0.0, 0.99, 200)))
    p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    error = np.sqrt(np.log(4 / confidence) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = np.argmin((u + error) / p)
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def train(positive: np.ndarray, unlabelled: np.ndarray, how: Learning = Learning()) -> tuple[Network | None, float]:
    """The network and the prior; none and 0.5 without rows of both kinds."""
    if len(positive) < 2 or len(unlabelled) < 2:
        return None, 0.5
    first = _fit(positive[::2], unlabelled[::2], None, how)
    prior = estimate_prior(first.score(positive[1::2]), first.score(unlabelled[1::2]))
    return _fit(positive, unlabelled, prior, how), prior


def least_hashes(ids: DataFrame, most: int) -> DataFrame:
    """The distinct doc_ids of the least hashes, at most this many.

    Ids are counted first and all but about the share that is needed filtered by hash, so that what is
    sorted does not grow with the input.
    """
    key = F.xxhash64("doc_id")
    share = 1.5 * most / max(1, ids.count())
    if share < 1:
        ids = ids.filter(key < int(-(2**63) + share * 2**64))
    return ids.select("doc_id").distinct().orderBy(key, "doc_id").limit(most)


def sample_features(docs: DataFrame, ids: DataFrame, most: int) -> np.ndarray:
    """Features of a text each of at most this many of the ids. The ids are broadcast: 8 bytes each."""
    schema = T.StructType([T.StructField("features", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = class_matrix()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in feature_rows(batch.column(0), classes)], pa.binary())], ["features"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(least_hashes(ids, most)), "doc_id")
    # Of rows with one doc_id the least text: the same in every run.
    rows = picked.groupBy("doc_id").agg(F.min("text").alias("text")).select("text").mapInArrow(released(run), schema).collect()
    return np.array([np.frombuffer(x) for x in sorted(r["features"] for r in rows)]).reshape(-1, N_FEATURES)


def score_quality(
    docs: DataFrame, positive_ids: DataFrame, unlabelled_ids: DataFrame, how: Learning = Learning(), carried: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The carried columns, score and prior for every row of docs (doc_id, text); other columns are ignored.
    No carried column may be named score or prior.

    positive_ids and unlabelled_ids hold the doc_id to learn from. Null and empty
    texts are scored too, repeated rows alike, a text of any length as one. Without rows to learn from all scores
    are 0.5; an empty table gives no rows. Rows are scored where they lie: no text but those of the sample is shuffled.
    """
    net, prior = train(sample_features(docs, positive_ids, how.max_sample), sample_features(docs, unlabelled_ids, how.max_sample), how)
    out = docs.select(*carried, F.col("text").alias("_read"))
    schema = T.StructType([*out.schema[:-1], T.StructField("score", T.DoubleType()), T.StructField("prior", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = class_matrix()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                few = batch.slice(at, 1000)
                found = np.full(few.num_rows, 0.5) if net is None else net.score(feature_rows(few.columns[-1], classes))
                yield pa.RecordBatch.from_arrays([*few.columns[:-1], pa.array(found), pa.array(np.full(len(found), prior))], schema.names)

    return out.mapInArrow(released(run), schema)


def learn_from(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id of trusted positives, by the labels that may be learnt from, and of the unlabelled: all other
    documents outside the held-out fold, whatever label they have.

    A doc_id labelled twice is positive only if every label says so; one that is null is not learnt from.
    """
    seen = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 3, 1)
    each = labels.filter(seen).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return each.filter("quality = 1").select("doc_id"), docs.filter(seen).select("doc_id")


def op1_pu_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, *learn_from(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), 3, 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "prior",
    )
