from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from pricelens.llm import repeats
from pricelens.llm.repeats import shared_passages


def brute(texts: list[bytes], length: int, keep: str) -> list[list[bool]]:
    """Which bytes go, by a dictionary of all strings in text order."""
    first: dict[bytes, tuple[int, int]] = {}
    count: dict[bytes, int] = {}
    for t, data in enumerate(texts):
        for s in range(len(data) - length + 1):
            part = data[s : s + length]
            first.setdefault(part, (t, s))
            count[part] = count.get(part, 0) + 1
    gone = []
    for t, data in enumerate(texts):
        covered = [False] * len(data)
        for s in range(len(data) - length + 1):
            part = data[s : s + length]
            if count[part] > 1 and (keep == "none" or first[part] != (t, s)):
                covered[s : s + length] = [True] * length
        gone.append(covered)
    return gone


def check(spark, documents, texts: list[str], length: int, keep: str, deep: int = 20_000) -> int:
    got = repeats.without_repeats(spark, documents(list(enumerate(texts))), length, keep, deep=deep)
    want = brute([t.encode() for t in texts], length, keep)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        data = text.encode()
        kept = bytes(b for b, gone in zip(data, want[i], strict=True) if not gone)
        assert bytes(rows[i]["kept"]) == kept, i
        assert rows[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        runs = sum(b and not a for a, b in zip([False, *want[i]], want[i], strict=False))
        assert len(rows[i]["spans"]) == runs and rows[i]["n_bytes"] == len(data)
    return sum(map(sum, want))


def corpus(seed: int, alphabet: str = "abcdefgh é") -> list[str]:
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choices(alphabet, k=n))
    passages = [text(n) for n in (30, 41, 60, 200)]
    texts = []
    for _ in range(60):
        parts = [text(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            parts += [p[a : len(p) - rng.randint(0, 10)], text(rng.randint(0, 50))]
        texts.append("".join(parts))
    return texts + [texts[5], texts[5], texts[7], passages[3] * 3, "", "z" * 300, "z" * 90, "zx" * 100]


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize(("seed", "length"), [(0, 40), (1, 41), (2, 25), (3, 130)])
def test_removal_matches_brute_force(spark, documents, seed, length, keep):
    assert check(spark, documents, corpus(seed), length, keep) > 500


@pytest.mark.parametrize("keep", ["none", "first"])
def test_two_letters(spark, documents, keep):
    assert check(spark, documents, corpus(9, "ab"), 40, keep) > 500


@pytest.mark.parametrize("keep", ["none", "first"])
def test_hot_buckets_are_deepened(spark, documents, keep):
    assert check(spark, documents, corpus(4), 40, keep, deep=1) > 500


def test_passage_shared_by_many(spark, documents):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choices("abcdefghijklmnop", k=n))
    passage = text(150)
    texts = [text(rng.randint(0, 120)) + passage + text(rng.randint(0, 120)) for _ in range(400)]
    got = repeats.without_repeats(spark, documents(list(enumerate(texts))), 100, "none", deep=50)
    for r in got.collect():
        assert any(s["stop"] - s["start"] >= 150 for s in r["spans"])
        assert passage[30:-30].encode() not in bytes(r["kept"])


def test_defined_cases(spark, documents):
    long_ = "0123456789" * 60
    rows = [(None, long_), (5, long_), (5, long_), (9, long_), (1, None), (2, "short"), (3, "short")]
    for keep, whole in (("none", 0), ("first", 1)):
        got = repeats.without_repeats(spark, documents(rows), 400, keep).collect()
        assert len(got) == 7
        copies = [r for r in got if r["n_bytes"] == 600]
        full = [r for r in copies if [(s["start"], s["stop"]) for s in r["spans"]] == [(0, 600)]]
        assert len(copies) - len(full) == whole  # of copies one row stays, cut for its own repeats
        if whole:
            (first,) = [r for r in copies if r not in full]
            assert first["doc_id"] == 5 and bytes(first["kept"]) == long_[:10].encode()
        assert {bytes(r["kept"]) for r in got if r["n_bytes"] < 600} == {b"", b"short"}
    assert repeats.without_repeats(spark, documents([])).collect() == []
    with pytest.raises(ValueError):
        repeats.without_repeats(spark, documents([]), keep="last")


def test_factors_of_a_small_bucket():
    # One core; suffixes "ab|cd", "ab|ce", "ab|cd" again: shift 2, step 5, length 10.
    bytes_ = np.frombuffer(b"abcdabceabcd", dtype=np.uint8).reshape(3, 4)
    one = np.ones(3, dtype=np.int64)
    previous, following = repeats.suffix_factors(one, 2 * one, bytes_, np.array([2, 0, 1]), 10, 5)
    assert previous.tolist() == [10, 0, 0] and following.tolist() == [0, 0, 10]


def test_places_beyond_one_piece(monkeypatch):
    monkeypatch.setattr(repeats, "_PLACE_BITS", 9)  # anchors of a text longer than a piece
    rng = np.random.default_rng(0)
    data = rng.integers(97, 123, 5000).astype(np.uint8)
    data[3000:3400] = data[100:500]
    hashes = repeats.Substrings(data, 1).windows(20)
    _, anchor, first, last = repeats.anchors(data, np.array([0, 5000]), hashes, 40)
    of = {s: a - s for a, f, z in zip(anchor, first, last, strict=True) for s in range(f, z + 1)}
    assert len(of) == 5000 - 40 + 1
    assert all(of[s] == of[s + 2900] for s in range(100, 461))


def test_documents_that_share_a_passage(spark, documents):
    rng = random.Random(5)

    def prose(n: int) -> list[str]:
        return ["".join(rng.choices("abcdefgh", k=rng.randrange(1, 7))) for _ in range(n)]

    passage, short = prose(51), prose(25)
    rows = [(i, " ".join(prose(30) + passage + prose(40))) for i in range(20)]
    rows += [(20, ", ".join(prose(5) + passage)), (21, " ".join(passage[:-1]))]
    rows += [(i, " ".join(prose(60) + short + prose(60))) for i in range(30, 50)]
    rows += [(50, " ".join(passage[:40] + prose(9))), (51, None), (52, ""), (None, " ".join(passage))]
    twice = " ".join(prose(200))
    rows += [(60, twice), (60, twice), (61, " ".join(prose(3) + passage * 2)), (62, " ".join(prose(20_000)))]
    got = {r["doc_id"] for r in shared_passages(documents(rows)).collect()}
    assert got >= set(range(21)) | {61}
    assert not got & {*range(30, 50), 51, 52, 60, 62, None}
    assert shared_passages(documents([])).collect() == []
