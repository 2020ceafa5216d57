"""Quality: Bradley-Terry scores learnt from preference pairs of documents.

Each labelled good document is preferred to each labelled bad one, and all such pairs train
linear scores by logistic loss on the difference of their features. Features describe the whole
text: symbols, case, digits, word and line shapes, repetition. Pairs are never listed: a step puts
every labelled document that is not held out into a cell of its score, tasks add up the features
and their products by class and cell, and the loss of a pair of cells counts all pairs of their
documents at the cells' mean scores. The threshold is a quantile of the scores of all these
documents, the one that parts the classes best; the published score is a logistic of
the distance to it, equal to ``THRESHOLD`` there. Scoring is one pass without a shuffle.

Defined cases: a NULL text counts as empty, whose features are all 0; without labels of both
classes nothing is learnt and every score is 0.5; NULL and repeated ids and further columns
do not matter to a score; a filter keeps rows and columns as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm.labelled import held_out, training_texts
from pricelens.llm.tables import area, column, table, whole_rows
from pricelens.llm.words import mix, shingles, text_blocks, word_hashes

THRESHOLD = 0.3
#: Held-out documents: crc32(id) % PARTS == PART.
PARTS, PART = 5, 0
#: Cells of a step's scores and of the threshold, over ``SPAN`` spreads of the score either way;
#: the outermost take in what lies beyond.
PAIR_CELLS, CUT_CELLS, SPAN = 256, 1 << 14, 6.0
RIDGE = 1e-3
#: What the threshold may give up of the best difference between the classes' pass rates.
GAIN_GIVEN_UP = 0.001
#: A task of a step takes at least about so many documents: each sends a whole table of sums.
ROWS_PER_TASK = 1 << 14
#: Newton steps end when no weight moves by more than this share of the largest.
_STEPS, _STILL = 25, 1e-4

_SPACE, _LOWER, _UPPER, _DIGIT, _MARK, _OTHER, _WIDE = range(7)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = _LOWER, _UPPER, _DIGIT, _WIDE
_KIND[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = _MARK

FEATURES = (
    "log_words", "word_bytes", "lower", "upper", "digit", "mark", "symbol", "wide",
    "pipe", "exclamation", "marked_words", "new_words", "new_shingles", "new_lines", "line_words",
)


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _new_share(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Distinct over all hashes of each text; 0 where a text has none."""
    n = np.diff(begins)
    of = np.repeat(np.arange(len(n)), n).astype(np.uint64)
    # Keyed by text, so an equal pair is a repetition within one text.
    kept = np.unique(mix(hashes ^ mix(of + np.uint64(1))), return_index=True)[1]
    distinct = np.bincount(of[kept].astype(np.int64), minlength=len(n))
    return distinct / np.maximum(n, 1)


def block_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per text of a block."""
    kind = _KIND[data]
    solid = kind != _SPACE
    visible = np.maximum(_per_text(solid, offsets), 1.0)
    hashes, firsts = word_hashes(data, offsets)
    words = np.diff(firsts)
    # Words by white space, and those of them that end in two or more symbols or marks.
    next_space = np.ones(len(data), dtype=bool)
    next_space[:-1] = ~solid[1:]
    next_space[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = solid & next_space
    odd = (kind == _OTHER) | (kind == _MARK)
    odd_before = np.zeros(len(data), dtype=bool)
    odd_before[1:] = odd[:-1]
    tokens = np.maximum(_per_text(ends, offsets), 1.0)
    newline = data == 10
    lines = _per_text(newline, offsets) + 1
    # A line is hashed by its position-weighted bytes, from one newline to the next.
    cuts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(newline) + 1]))
    cuts = cuts[cuts < len(data)]
    line_hash = np.zeros(0, dtype=np.uint64)
    if len(cuts):
        position = np.arange(len(data), dtype=np.uint64)
        start = np.repeat(cuts, np.diff(np.append(cuts, len(data)))).astype(np.uint64)
        keyed = mix((position - start) * np.uint64(257) + data.astype(np.uint64) + np.uint64(1))
        line_hash = np.add.reduceat(keyed, cuts)
    found = np.column_stack(
        [
            np.log1p(words),
            visible / tokens,
            _per_text(kind == _LOWER, offsets) / visible,
            _per_text(kind == _UPPER, offsets) / visible,
            _per_text(kind == _DIGIT, offsets) / visible,
            _per_text(kind == _MARK, offsets) / visible,
            _per_text(kind == _OTHER, offsets) / visible,
            _per_text(kind == _WIDE, offsets) / visible,
            _per_text(data == 124, offsets) / tokens,
            _per_text(data == 33, offsets) / tokens,
            _per_text(ends & odd & odd_before, offsets) / tokens,
            _new_share(hashes, firsts),
            _new_share(*shingles(data, offsets, 5)),
            _new_share(line_hash, np.searchsorted(cuts, offsets)),
            np.log1p(words / lines),
        ]
    )
    found[np.diff(offsets) == 0] = 0.0
    return found


def _features(batch: pa.RecordBatch) -> np.ndarray:
    parts = [block_features(data, at) for _, _, data, at in text_blocks(batch.column("text"))]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = pa.array(list(_features(batch)), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), rows], names=["label", "features"]
        )


#: An array of sums over rows of features and labels, and the same over all rows wherever they are.
Part = Callable[[np.ndarray, np.ndarray], np.ndarray]
Summed = Callable[[Part], np.ndarray]


def _standard(x: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.clip((x - centre) / spread, -8, 8)


def _cell(scores: np.ndarray, reach: float, cells: int) -> np.ndarray:
    place = np.floor((scores + reach) / (2 * reach) * cells)
    return np.clip(place, 0, cells - 1).astype(np.int64)


def _by_place(places: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` that share a place."""
    found = np.zeros((n, values.shape[1]))
    order = np.argsort(places, kind="stable")
    if len(order):
        at, begins = np.unique(places[order], return_index=True)
        found[at] = np.add.reduceat(values[order], begins, axis=0)
    return found


def _pair_sums(scaled: np.ndarray, labels: np.ndarray, w: np.ndarray, reach: float) -> np.ndarray:
    """By class and cell of the score: documents, their features, and products of two features."""
    a, b = np.triu_indices(scaled.shape[1])
    values = np.column_stack([np.ones(len(scaled)), scaled, scaled[:, a] * scaled[:, b]])
    places = labels * PAIR_CELLS + _cell(scaled @ w, reach, PAIR_CELLS)
    return _by_place(places, values, 2 * PAIR_CELLS)


def _newton_step(sums: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What to take from the weights for the ridge-regularised loss of all pairs; the features'
    second moments."""
    d = len(w)
    n, x = sums[:, 0], sums[:, 1 : d + 1]
    products = np.zeros((len(sums), d, d))
    a, b = np.triu_indices(d)
    products[:, a, b] = products[:, b, a] = sums[:, d + 1 :]
    mean = (x @ w) / np.maximum(n, 1.0)
    bad, good = slice(None, PAIR_CELLS), slice(PAIR_CELLS, None)
    gap = mean[good][:, None] - mean[bad][None, :]
    p = 1.0 / (1.0 + np.exp(-np.clip(gap, -35, 35)))
    pairs = n[good].sum() * n[bad].sum()
    gradient = ((n[good] @ (1 - p)) @ x[bad] - ((1 - p) @ n[bad]) @ x[good]) / pairs + RIDGE * w
    weight = p * (1 - p)
    cross = x[good].T @ weight @ x[bad]
    curvature = (
        np.tensordot(weight @ n[bad], products[good], 1)
        + np.tensordot(n[good] @ weight, products[bad], 1)
        - cross
        - cross.T
    ) / pairs
    return np.linalg.solve(curvature + RIDGE * np.eye(d), gradient), products.sum(axis=0) / n.sum()


def _cut(below: np.ndarray, reach: float) -> float:
    """The threshold from the bad and good documents in each cell of the score."""
    edges = np.linspace(-reach, reach, len(below) + 1)[1:-1]
    bad, good = np.cumsum(below, axis=0)[:-1].T
    gain = bad / below[:, 0].sum() - good / below[:, 1].sum()
    # Of quantiles that are about as good, the lowest: a good document that is lost costs more
    # than a bad one that stays. Where the best one alone is good, the middle of its gap.
    lowest = np.flatnonzero(gain >= gain.max() - GAIN_GIVEN_UP)[0]
    same = np.flatnonzero(gain >= gain[lowest] - 1e-12)
    same = same[same >= lowest]
    run = same[: np.flatnonzero(np.append(np.diff(same) > 1, True))[0] + 1]
    rank = (bad + good)[run]
    gap = run[rank == rank[np.argmin(np.abs(rank - (rank[0] + rank[-1] + 1) // 2))]]
    return float(edges[gap[len(gap) // 2]])


def learnt(summed: Summed, size: int) -> dict[str, np.ndarray]:
    """Weights of the ``size`` standardised features, and the threshold on the score.

    Empty unless both classes have documents. Numbers are rounded, as the order in which tasks
    add up would else show in their last digits.
    """

    def by_class(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
        return _by_place(labels, np.column_stack([np.ones(len(x)), x]), 2)

    moments = summed(by_class)
    if not moments[:, 0].all():
        return {}
    n = moments[:, 0].sum()
    centre = np.round(moments[:, 1:].sum(axis=0) / n, 12)
    squares = summed(lambda x, labels: ((x - centre) ** 2).sum(axis=0, keepdims=True))[0]
    spread = np.round(np.sqrt(squares / n), 12)
    spread[spread < 1e-9] = 1.0
    w, reach = np.zeros(size), 1.0
    for _ in range(_STEPS):
        sums = summed(lambda x, y: _pair_sums(_standard(x, centre, spread), y, w, reach))
        step, moment = _newton_step(sums, w)
        w = np.round(w - step, 12)
        reach = max(SPAN * float(np.sqrt(w @ moment @ w)), 1e-6)
        if np.abs(step).max() <= _STILL * np.abs(w).max():
            break

    def cells(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
        places = _cell(_standard(x, centre, spread) @ w, reach, CUT_CELLS)
        return _by_place(places, np.column_stack([labels == 0, labels == 1]) * 1.0, CUT_CELLS)

    cut = np.array([_cut(summed(cells), reach)])
    return {"centre": centre, "spread": spread, "weights": w, "cut": cut}


def bradley_terry(x: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """The model of rows that are at hand; ``fit_quality`` learns the same from a table."""
    labels = labels.astype(np.int64)
    return learnt(lambda part: part(x, labels), x.shape[1])


def _summed_over(rows: DataFrame) -> Summed:
    """Sums over the (label, features) of a table; only what is not 0 is moved.

    A task sends each of its sums as a row, and Spark adds them up: of a step's few rows a Python
    task a partition would take longer than its work.
    """

    def summed(part: Part) -> np.ndarray:
        empty = part(np.zeros((0, len(FEATURES))), np.zeros(0, dtype=np.int64))

        def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros(empty.shape)
            for batch in batches:
                x = batch.column("features").flatten().to_numpy().reshape(-1, len(FEATURES))
                found += part(x, batch.column("label").to_numpy().astype(np.int64))
            held = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(held, pa.int64()), pa.array(found.ravel()[held])], names=["place", "value"]
            )

        parts = rows.mapInArrow(of_task, "place long, value double")
        added = parts.groupBy("place").agg(F.sum("value").alias("value")).toArrow()
        total = np.zeros(empty.size)
        total[added["place"].to_numpy()] = added["value"].to_numpy()
        return total.reshape(empty.shape)

    return summed


def fit_quality(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    """The fitted model, a few dozen numbers; empty where there is nothing to learn from.

    Learns from every labelled document that is not held out. Their features are written once.
    """
    told = training_texts(docs, labels, "quality", PARTS, PART, most=None).select("label", "text")
    rows = told.mapInArrow(_feature_rows, "label int, features array<double>")
    with area(docs.sparkSession) as place:
        written = place.put("quality_features", rows)
        tasks = max(1, -(-written.count() // ROWS_PER_TASK))
        return learnt(_summed_over(written.coalesce(tasks)), len(FEATURES))


def model_scores(x: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    if not model:
        return np.full(len(x), 0.5)
    scaled = np.clip((x - model["centre"]) / model["spread"], -8, 8)
    distance = scaled @ model["weights"] - model["cut"][0]
    logit = distance + np.log(THRESHOLD / (1 - THRESHOLD))
    return 1.0 / (1.0 + np.exp(-np.clip(logit, -35, 35)))


def with_quality(rows: DataFrame, model: dict[str, np.ndarray], carried: list[str]) -> DataFrame:
    """The ``carried`` columns of ``rows`` and the ``score`` of their column ``text``."""

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model_scores(_features(batch), model)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in carried], pa.array(found)],
                names=[*carried, "score"],
            )

    schema = rows.select(*carried).schema.add("score", "double")
    return rows.mapInArrow(scores, schema)


def score_quality(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    told = docs.select(
        column("doc_id"),
        held_out("doc_id", PARTS, PART).alias("held_out"),
        F.coalesce(column("text"), F.lit("")).alias("text"),
    )
    return with_quality(told, model, ["doc_id", "held_out"]).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def drop_low_quality(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with their columns unchanged."""
    told = docs.select(
        whole_rows(docs).alias("whole"), F.coalesce(column("text"), F.lit("")).alias("text")
    )
    return (
        with_quality(told, model, ["whole"]).where(F.col("score") >= THRESHOLD).select("whole.*")
    )


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, folder, "labels")))
