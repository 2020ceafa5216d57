from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pricelens.llm import near
from pricelens.llm.components import components
from pricelens.llm.words import text_blocks
from tests.conftest import local_frame


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(n)]


def corpus(seed: int = 0) -> list[str]:
    """Groups of edited copies, some copies of copies, and unrelated texts."""
    rng = random.Random(seed)
    texts = [" ".join(words(rng, rng.randint(1, 150))) for _ in range(60)]
    for size in (2, 5, 30):
        base = words(rng, 200)
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(1, 5)):
                copy[rng.randrange(200)] = words(rng, 1)[0]
            texts.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy
    return texts


def brute_components(texts: list[str]) -> dict[str, str]:
    """Components of weighted Jaccard links over all pairs, in plain Python."""
    shingles = []
    for text in texts:
        w = text.split()
        parts = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
        shingles.append(Counter(parts))
    slots = []
    for text in texts:  # the slots of the engine, by its own hashes
        (block,) = text_blocks(pa.array([text]))
        hashes, counts, _ = near._distinct(*near.shingles(block[2], block[3], 5))
        slots.append((hashes, counts))
    frequencies = np.zeros(1 << near.SLOT_BITS, dtype=np.int64)
    for hashes, _ in slots:
        frequencies[np.unique(near._slots(hashes))] += 1
    idf = near.inverse_frequencies(frequencies, sum(bool(len(h)) for h, _ in slots)).astype(float)
    weights = [dict(zip(h.tolist(), (c * idf[near._slots(h)]).tolist(), strict=True)) for h, c in slots]
    assert [len(w) for w in weights] == [len(s) for s in shingles]
    parent = list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = weights[i], weights[j]
            shared = sum(min(v, b[k]) for k, v in a.items() if k in b)
            union = sum(a.values()) + sum(b.values()) - shared
            if union and shared / union >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in range(len(texts))}


def test_classes_match_brute_force(spark, documents):
    texts = corpus()
    got = {r["doc_id"]: r for r in near.near_duplicates(spark, documents(list(enumerate(texts)))).collect()}
    want = brute_components(texts)
    assert {i: r["class_id"] for i, r in got.items()} == want
    sizes = Counter(want.values())
    assert all(r["class_size"] == sizes[want[i]] and r["kept"] == (want[i] == i) for i, r in got.items())
    assert max(sizes.values()) > 5


def test_open_buckets_are_compared_in_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 4)  # a group of thirty meets in many blocks
    texts = corpus(3)
    got = near.near_duplicates(spark, documents(list(enumerate(texts)))).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_components(texts)


def test_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 2**63, 300, dtype=np.uint64)
    a, b = (np.unique(np.concatenate([shared, rng.integers(0, 2**63, n, dtype=np.uint64)])) for n in (60, 90))
    weight = lambda h: (1 + (h % np.uint64(5))).astype(np.float32) / 2
    wa, wb = weight(a), weight(b)
    heavier = wb * np.where(np.isin(b, shared[:100]), 1.5, 1).astype(np.float32)
    begins = np.array([0, len(a), len(a) + len(b)])
    samples = near.weighted_samples(np.concatenate([a, b]), np.concatenate([wa, heavier]), begins, 3000)
    true = near.weighted_jaccard((a, wa.astype(float)), (b, heavier.astype(float)))
    assert (samples[0] == samples[1]).mean() == pytest.approx(true, abs=0.03)


def test_shared_weights_match_single_pairs():
    idf = np.linspace(1, 3, 1 << near.SLOT_BITS).astype(np.float32)
    texts = pa.array(["a b c d e f g " * 30, "a b c d e f g h " * 20, "x", "", "a b c d e f"])
    found = near._weighted_texts(texts, idf)
    shared = near._shared_weight(found, idf)
    for i, a in enumerate(found):
        for j, b in enumerate(found[:i]):  # what only one text has is left out of the products
            total = a[1].sum() + b[1].sum()
            ratio = shared[i, j] / (total - shared[i, j]) if total > shared[i, j] else 0
            assert ratio == pytest.approx(near.weighted_jaccard(a, b), abs=1e-4)


def test_defined_cases(spark, documents):
    long_ = "one two three four five six seven eight nine ten"
    rows = [
        (1, None), (2, ""), (3, "..."), (4, ""),  # without words: never linked
        (10, long_), (11, long_.upper()), (12, long_ + "."), (None, long_), (10, long_),
        (20, "short"), (21, "Short"), (22, "other"),
    ]
    docs = documents(rows)
    got = [(r["doc_id"], r["class_id"], r["class_size"], r["kept"]) for r in near.near_duplicates(spark, docs).collect()]
    for i in (1, 2, 3, 4):
        assert (i, i, 1, True) in got
    ten = [r for r in got if r[1] == 10]
    assert len(ten) == 5 and {r[2] for r in ten} == {5} and sum(r[3] for r in ten) == 1
    assert (20, 20, 2, True) in got and (21, 20, 2, False) in got and (22, 22, 1, True) in got
    kept = near.drop_near_copies(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 10, 20, 22]
    assert near.near_duplicates(spark, documents([])).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    links += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(200)]
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = components(spark, local_frame(spark, links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {i: root(i) for i in list(parent)}
    assert len(got) == len(parent)
