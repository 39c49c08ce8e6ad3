"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams (operator 4).

Features of a text are its distinct words, word pairs and pairs with one word between, lower-cased,
hashed to ``2 ** BITS`` places. FTRL-proximal keeps a learning rate per coordinate and sets weights of
small evidence to zero (L1), so what is broadcast are at most ``2 ** BITS`` weights, in practice some
thousands. It learns from at most ``TRAIN_ROWS`` labelled rows (those of the least hash, a documented
bound) whose ``crc32(doc_id) mod 4`` is not 2, in one task; every document is then scored in one narrow
stage. Score: the probability of label 1.

Cases: NULL and empty texts have no features and get the score of the bias; labels that are NULL, or of
unknown documents, teach nothing; several labels of one document count as toxic if any is; without any
labelled row all scores are 0. Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from corpuslens.llm.batches import PLAIN, WORD_SLICE, Words, column, mix, slices
from corpuslens.llm.shared import sent_text, text_of

BITS = 20
TRAIN_ROWS = 20_000
THRESHOLD = 0.3
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 1.0

def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of every word, pair and skip pair (repeats included)."""
    words = Words(texts, plain=PLAIN)
    h, rows = words.hashes, words.owner()
    places, owners = [h], [rows]
    for gap in (1, 2):
        if len(h) > gap:
            same = rows[gap:] == rows[:-gap]
            places.append(mix(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] + np.uint64(gap))[same])
            owners.append(rows[gap:][same])
    return np.concatenate(owners), (np.concatenate(places) >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """FTRL-proximal: per-coordinate sums of gradients ``z`` and of their squares ``n``."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: float) -> None:
        w, n = self.weights(at), self.n[at]
        g = sigmoid(w.sum()) - label
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights that are not zero; place ``2 ** bits`` is the bias."""
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("_label"))
        .withColumn("_order", F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)))
        .orderBy("_order", "doc_id").limit(rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = Ftrl((1 << bits) + 1), []
        for part in slices(batches, limit=WORD_SLICE):
            owner, place = features(column(part, "text"), bits)
            order = np.lexsort((place, owner))
            owner, place = owner[order], place[order]
            upto = np.searchsorted(owner, np.arange(part.num_rows + 1))
            for i, label in enumerate(column(part, "_label").to_pylist()):
                seen.append((np.append(np.unique(place[upto[i] : upto[i + 1]]), 1 << bits).astype(np.int32), float(label)))
        for _ in range(EPOCHS):
            for at, label in seen:
                model.learn(at, label)
        weights = model.weights()
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(weights[at])], ["place", "weight"])

    # the sample is bounded by ``rows``, so it may be broadcast and read by one task
    sample = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(known), "doc_id")
    found = sample.repartition(1).sortWithinPartitions("_order", "doc_id").select("text", "_label")
    held = found.mapInArrow(run, "place long, weight double").toPandas()
    return held["place"].to_numpy(np.int64), held["weight"].to_numpy(float)


def score(docs: DataFrame, places: np.ndarray, weights: np.ndarray, columns: list[str], bits: int = BITS) -> DataFrame:
    """``columns`` of every row and its ``__cl_score``; one narrow stage."""
    dense = np.zeros((1 << bits) + 1)
    dense[places] = weights
    model = docs.sparkSession.sparkContext.broadcast(dense.astype(np.float32))
    taught = len(places) > 0
    sent, text = sent_text(docs, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for part in slices(batches, text, WORD_SLICE):
            owner, place = features(column(part, text), bits)
            said = w[place] != 0
            once = np.unique((owner[said] << (bits + 1)) | place[said])
            total = np.bincount(once >> (bits + 1), w[once & ((1 << (bits + 1)) - 1)], part.num_rows) + w[-1]
            yield pa.RecordBatch.from_arrays(
                [column(part, name) for name in columns] + [pa.array(sigmoid(total) if taught else np.zeros(part.num_rows))],
                [*columns, "__cl_score"],
            )

    schema = T.StructType([*(docs.schema[name] for name in columns), T.StructField("__cl_score", T.DoubleType())])
    return docs.select(*sent).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    return score(docs.select("doc_id", "text"), *train(docs, labels), columns=["doc_id"]).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("__cl_score").alias("score"),
        (F.col("__cl_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
