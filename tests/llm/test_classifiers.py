from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from pricelens.llm import quality, toxicity
from pricelens.llm.labelled import training_texts
from pricelens.llm.tables import table
from pricelens.llm.words import joined, shingles, text_blocks, word_hashes
from tests.conftest import local_frame

FOLDER = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int, text string"


def blocks(texts):
    import pyarrow as pa

    return list(text_blocks(pa.array(texts, pa.string())))


def test_words_do_not_cross_texts():
    (first, end, data, offsets), = blocks(["ab cd", "cd", "", "ab  cd!", "é"])
    hashes, firsts = word_hashes(data, offsets)
    assert firsts.tolist() == [0, 2, 3, 3, 5, 6]
    assert hashes[1] == hashes[2] == hashes[4] and hashes[0] == hashes[3] != hashes[1]
    pairs, begins = joined(hashes, firsts, (0, 1))
    assert begins.tolist() == [0, 1, 1, 1, 2, 2] and pairs[0] == pairs[1]


def test_shingles_of_short_texts():
    (_, _, data, offsets), = blocks(["a b c d e f", "a b", "", "a b", "b a"])
    hashes, begins = shingles(data, offsets, 5)
    assert begins.tolist() == [0, 2, 3, 3, 4, 5]
    assert hashes[2] == hashes[3] != hashes[4]


def test_a_long_text_is_one_block():
    found = blocks(["x " * 2_000_000, "y", "z"])
    assert [(a, b) for a, b, _, _ in found] == [(0, 1), (1, 3)]


def auc(score, label) -> float:
    rank = np.argsort(np.argsort(score))
    ones = label == 1
    return (rank[ones].mean() - (ones.sum() - 1) / 2) / (~ones).sum()


@pytest.mark.parametrize("name", ["toxic", "quality"])
def test_held_out_accuracy(spark, name):
    docs, labels = (table(spark, FOLDER, t) for t in ("documents", "labels"))
    if name == "toxic":
        scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
        parts, part = 4, 2
    else:
        scored = quality.score_quality(docs, quality.fit_quality(docs, labels))
        parts, part = 5, 0
    rows = scored.toPandas()
    assert len(rows) == docs.count()
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.3) == (rows.predicted == 1)).all()
    want = [zlib.crc32(str(i).encode()) % parts == part for i in rows.doc_id]
    assert (rows.held_out == want).all()
    held = rows[rows.held_out].merge(labels.toPandas(), on="doc_id")
    # Some documents of this table are labelled toxic without a toxic word.
    assert auc(held.score.to_numpy(), held[name].to_numpy()) > (0.95 if name == "toxic" else 0.98)
    assert (held.predicted == held[name]).mean() > 0.97


def test_ftrl_finds_the_words_and_stays_sparse():
    rng = np.random.default_rng(0)
    sets, labels = [], []
    for i in range(1500):
        common = rng.integers(100, 4000, 60)
        toxic = i % 5 == 0
        sets.append(np.unique(np.append(common, [7, 9][i % 2]) if toxic else common))
        labels.append(float(toxic))
    at, weight, bias = toxicity.ftrl(sets, np.array(labels))
    assert {7, 9} <= set(at.tolist()) and len(at) < 400 and bias < 0
    assert weight[np.isin(at, [7, 9])].min() > 1


def test_bradley_terry_orders_the_pairs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 4))
    labels = (x[:, 0] - 0.5 * x[:, 2] + 0.2 * rng.normal(size=800) > -0.8).astype(int)
    model = quality.bradley_terry(x, labels)
    assert model["weights"][0] > 0 > model["weights"][2]
    score = quality.model_scores(x, model)
    assert ((score >= quality.THRESHOLD) == (labels == 1)).mean() > 0.9


def test_sample_is_bounded_and_not_held_out(spark, documents):
    docs = documents([(i, f"t{i}") for i in range(100)] + [(3, "other")] * 20)
    labels = local_frame(spark, [(i, 1, i % 2, "x") for i in range(100)] + [(None, 1, 1, ""), (5, None, None, "")], LABELS)
    rows = training_texts(docs, labels, "toxic", 4, 2, most=30).collect()
    assert len(rows) == 30 and len({r["doc_id"] for r in rows}) == 30
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 for r in rows)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_nulls_no_labels_and_empty(spark, documents, module):
    fit, score = (
        (toxicity.fit_toxicity, toxicity.score_toxicity)
        if module is toxicity
        else (quality.fit_quality, quality.score_quality)
    )
    docs = documents([(1, None), (None, "a b"), (1, "x " * 50_000), (2, "")])
    none = local_frame(spark, [], LABELS)
    rows = score(docs, fit(docs, none)).collect()
    assert len(rows) == 4 and len({r["score"] for r in rows}) == 1
    assert score(documents([]), fit(documents([]), none)).collect() == []


def test_filter_drops_junk_and_keeps_columns(spark, documents):
    rng = random.Random(0)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 8)))
    good = [" ".join(word() for _ in range(80)) + "." for _ in range(150)]
    bad = [" ".join(word().upper() + "$$$ |" for _ in range(80)) for _ in range(150)]
    rows = list(enumerate(good + bad))
    labels = local_frame(spark, [(i, int(i < 150), 0, "x") for i in range(300)], LABELS)
    docs = documents(rows)
    kept = quality.drop_low_quality(docs, quality.fit_quality(docs, labels))
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert len(ids & set(range(150))) >= 148 and len(ids - set(range(150))) <= 2


def test_features_of_empty_text_are_zero():
    (_, _, data, offsets), = blocks(["", "a b", ""])
    found = quality.block_features(data, offsets)
    assert (found[[0, 2]] == 0).all() and found[1].any()
    assert np.isfinite(found).all()


@pytest.mark.parametrize("module", [toxicity, quality])
def test_text_ids(spark, module):
    rows = [(f"id-{i}", i % 2, "bad awful stupid words" if i % 2 else "a calm and kind sentence.") for i in range(80)]
    labelled = local_frame(spark, rows, "doc_id string, label int, text string")
    docs = labelled.select("doc_id", "text")
    labels = labelled.selectExpr("doc_id", "label AS toxic", "1 - label AS quality")
    fit, score = (
        (toxicity.fit_toxicity, toxicity.score_toxicity)
        if module is toxicity
        else (quality.fit_quality, quality.score_quality)
    )
    got = score(docs, fit(docs, labels)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    scores = {r["doc_id"]: r["score"] for r in got}
    assert len({round(v, 9) for v in scores.values()}) == 2


def test_quality_learns_from_every_labelled_document(spark, documents, monkeypatch):
    monkeypatch.setattr("pricelens.llm.labelled.MAX_TRAINING_DOCS", 10)
    texts = [(i, "Calm words follow here." * (1 + i % 5) if i % 3 else "$$ | BUY!! " * 9) for i in range(120)]
    labels = local_frame(spark, [(i, int(i % 3 > 0), 0, "x") for i in range(120)], LABELS)
    seen = []
    learnt = quality.learnt
    monkeypatch.setattr(quality, "learnt", lambda summed, n: seen.append(
        summed(lambda x, y: np.array([[len(x), y.sum()]], dtype=float))
    ) or learnt(summed, n))
    model = quality.fit_quality(documents(texts), labels)
    told = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5 != 0]
    assert seen[0].tolist() == [[len(told), sum(i % 3 > 0 for i in told)]]
    x = np.concatenate([quality.block_features(d, o) for _, _, d, o in blocks([texts[i][1] for i in told])])
    want = quality.bradley_terry(x, np.array([int(i % 3 > 0) for i in told]))
    assert all(np.allclose(model[k], want[k], atol=1e-6) for k in want)


def test_weights_are_those_of_all_pairs():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    labels = (x @ [1.0, -0.5, 0.0] + rng.normal(size=300) > 0.3).astype(int)
    model = quality.bradley_terry(x, labels)
    scaled = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -8, 8)
    gap = (scaled[labels == 1][:, None, :] - scaled[labels == 0][None, :, :]).reshape(-1, 3)
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-gap @ w))
        step = gap.T @ (p - 1) / len(gap) + quality.RIDGE * w
        w -= np.linalg.solve((gap * (p * (1 - p))[:, None]).T @ gap / len(gap) + quality.RIDGE * np.eye(3), step)
    assert np.abs(model["weights"] - w).max() < 0.005


def test_a_step_starts_python_only_for_the_features(spark, monkeypatch):
    values = [(i % 2, [float(i % 7 - j) for j in range(len(quality.FEATURES))]) for i in range(90)]
    rows = local_frame(spark, values, "label int, features array<double>").repartition(5)
    started, map_in_arrow = [], type(rows).mapInArrow
    monkeypatch.setattr(
        type(rows), "mapInArrow", lambda frame, *a, **k: started.append(1) or map_in_arrow(frame, *a, **k)
    )
    w = np.linspace(-1, 1, len(quality.FEATURES))
    part = lambda x, y: quality._pair_sums(x, y, w, 6.0)
    found = quality._summed_over(rows)(part)
    want = part(np.array([x for _, x in values]), np.array([y for y, _ in values]))
    assert len(started) == 1 and np.allclose(found, want)
    assert quality._summed_over(rows.limit(0))(part).shape == want.shape
