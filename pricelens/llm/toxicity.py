"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is the set of its single words, pairs of neighbours and pairs with one word between,
each hashed to one of ``2 ** BITS`` coordinates. Coordinates learn at rates of their own, and
the L1 term keeps most weights at exactly zero, so the fitted model is a short list of
(coordinate, weight) that goes to every task. It is fitted on a bounded sample of labelled
documents (``labelled.MAX_TRAINING_DOCS``); the sample, not the corpus, is what one task holds.
Scoring is one pass over whole texts without a shuffle.

Defined cases: a NULL or empty text scores the bias alone; without any label of either class
the model is empty and every score is ``PRIOR``; NULL and repeated ids and further columns do
not matter to a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm.labelled import held_out, training_texts
from pricelens.llm.tables import column, table
from pricelens.llm.words import joined, text_blocks, word_hashes

BITS = 20
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.0
EPOCHS = 8
THRESHOLD = 0.3
PRIOR = 0.1
#: Held-out documents: crc32(id) % PARTS == PART.
PARTS, PART = 4, 2
_BIAS = -1


def coordinates(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Coordinates of the three kinds of a block, each with where its texts begin."""
    hashes, firsts = word_hashes(data, offsets)
    shift = np.uint64(64 - BITS)
    kinds = [(hashes, firsts), joined(hashes, firsts, (0, 1)), joined(hashes, firsts, (0, 2))]
    return [((h >> shift).astype(np.int32), begins) for h, begins in kinds]


def _feature_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets: list[np.ndarray] = []
        for first, end, data, offsets in text_blocks(batch.column("text")):
            kinds = coordinates(data, offsets)
            for i in range(end - first):
                sets.append(np.unique(np.concatenate([c[b[i] : b[i + 1]] for c, b in kinds])))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array(sets, pa.list_(pa.int32()))],
            names=["doc_id", "label", "features"],
        )


def ftrl(sets: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple:
    """Fitted (coordinates, weights, bias) of the sparse examples, taken in the given order."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - L1, 0.0)
        shrunk[-1] = zs[-1]  # the bias, last of every example, is not shrunk by L1
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    examples = [np.append(s, size) for s in sets]
    for _ in range(epochs):
        for at, label in zip(examples, labels, strict=True):
            w = weights(at)
            gradient = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            squared = gradient * gradient
            sigma = (np.sqrt(n[at] + squared) - np.sqrt(n[at])) / ALPHA
            z[at] += gradient - sigma * w
            n[at] += squared
    w = weights(np.arange(size + 1))
    found = np.flatnonzero(w[:size])
    return found, w[found], float(w[size])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets, labels = [], []
    for batch in batches:
        features = batch.column("features")
        flat, ends = features.values.to_numpy(zero_copy_only=False), features.offsets.to_numpy()
        sets += [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        labels += batch.column("label").to_pylist()
    if len(set(labels)) < 2:
        return
    at, w, bias = ftrl(sets, np.array(labels, dtype=float))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, _BIAS), pa.int32()), pa.array(np.append(w, bias), pa.float64())],
        names=["at", "weight"],
    )


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, bias) learnt from the sample; at most ``2 ** BITS`` weights."""
    sample = training_texts(docs, labels, "toxic", PARTS, PART)
    id_type = sample.schema["doc_id"].dataType.simpleString()
    sets = sample.select("doc_id", "label", F.lower("text").alias("text")).mapInArrow(
        _feature_sets, f"doc_id {id_type}, label int, features array<int>"
    )
    order = sets.repartition(1).sortWithinPartitions(F.xxhash64(F.lit(7), "doc_id"), "doc_id")
    rows = order.select("label", "features").mapInArrow(_fit, "at int, weight double").toArrow()
    at, weight = rows.column("at").to_numpy(), rows.column("weight").to_numpy()
    bias = weight[at == _BIAS]
    keep = at != _BIAS
    prior = float(np.log(PRIOR / (1 - PRIOR)))
    return at[keep], weight[keep], float(bias[0]) if len(bias) else prior


def block_scores(data: np.ndarray, offsets: np.ndarray, dense: np.ndarray, bias: float):
    """Scores of a block's texts; a coordinate counts once per text."""
    texts, found = [], []
    for at, begins in coordinates(data, offsets):
        hit = np.flatnonzero(dense[at])
        texts.append(np.searchsorted(begins, hit, side="right") - 1)
        found.append(at[hit])
    pairs = np.unique((np.concatenate(texts) << BITS) | np.concatenate(found))
    sums = np.bincount(
        pairs >> BITS, weights=dense[pairs & ((1 << BITS) - 1)], minlength=len(offsets) - 1
    )
    return 1.0 / (1.0 + np.exp(-np.clip(sums + bias, -35, 35)))


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    at, weight, bias = model

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS)
        dense[at] = weight
        for batch in batches:
            found = np.zeros(batch.num_rows)
            for first, end, data, offsets in text_blocks(batch.column("text")):
                found[first:end] = block_scores(data, offsets, dense, bias)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(found)],
                names=["doc_id", "held_out", "score"],
            )

    told = docs.select(
        column("doc_id"),
        held_out("doc_id", PARTS, PART).alias("held_out"),
        F.lower(F.coalesce(column("text"), F.lit(""))).alias("text"),
    )
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double"
    return told.mapInArrow(scores, schema).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, folder, "labels")))
