from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pricelens.llm import packing


def pieces_in(bins: Counter) -> Counter:
    found: Counter = Counter()
    for pattern, times in bins.items():
        for length in pattern:
            found[length] += times
    return found


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_every_piece(seed):
    rng = random.Random(seed)
    histogram = Counter(rng.randint(1, 100) for _ in range(rng.choice([1, 40, 3000])))
    bins = packing.best_fit_decreasing(histogram, 100)
    searched = packing.local_search(bins, 100)
    for found in (bins, searched):
        assert pieces_in(found) == histogram
        assert all(0 < sum(p) <= 100 for p in found)
    least = -(-sum(k * v for k, v in histogram.items()) // 100)
    assert least <= searched.total() <= bins.total()


def test_search_empties_a_bin():
    bins = Counter({(6, 2): 1, (5, 4): 1, (3,): 1})  # 20 tokens in three bins of ten
    assert packing.local_search(bins, 10).total() == 2


def test_search_runs_to_its_end():
    rng = random.Random(0)  # lengths of which best fit leaves one sequence in sixteen too many
    histogram = Counter(rng.randint(450, 1100) for _ in range(4000))
    bins = packing.best_fit_decreasing(histogram, 2048)
    searched = packing.local_search(bins, 2048)
    assert pieces_in(searched) == histogram
    assert bins.total() >= 1600 and searched.total() <= 1575
    under = [p for p in searched if sum(p) < 2048]
    for i, low in enumerate(under):
        for high in under[i + (searched[low] < 2) :]:
            assert not packing._exchange(*sorted((low, high), key=sum), 2048)


@pytest.mark.parametrize("times", [10**3, 10**9])
def test_search_ends_on_many_equal_bins(times):
    rng = random.Random(1)
    histogram = {length: rng.randint(1, times) for length in range(20, 110, 3)}
    bins = packing.best_fit_decreasing(histogram, 200)
    searched = packing.local_search(bins, 200)
    held = Counter()
    for pattern, n in searched.items():
        assert sum(pattern) <= 200
        for length in pattern:
            held[length] += n
    assert held == histogram
    assert -(-sum(k * v for k, v in histogram.items()) // 200) <= searched.total() <= bins.total()


@pytest.mark.parametrize("seed", range(20))
def test_partners_by_table_are_those_of_single_tests(seed):
    rng = random.Random(seed)
    under, all_ = packing._Underfull(40), set()
    while len(all_) < 70:
        pattern = tuple(sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 5))), reverse=True))
        if sum(pattern) < 40:
            all_.add(pattern)
            under.add(pattern, rng.randint(1, 2))
    for gone in rng.sample(sorted(all_), 20):
        under.drop(gone, under.times[gone])
        all_.remove(gone)
    for pattern in all_:
        can = [
            sum(other)
            for other in all_
            if (other != pattern or under.times[pattern] > 1)
            and packing._exchange(*sorted((pattern, other), key=lambda p: (sum(p), p != pattern)), 40)
        ]
        found = under.partner(pattern)
        assert (sum(found) if found else None) == (max(can) if can else None)


def test_every_exchange_raises_the_squared_fill():
    rng = random.Random(1)
    for _ in range(300):
        low, high = (tuple(rng.randint(1, 30) for _ in range(rng.randint(1, 4))) for _ in range(2))
        if sum(low) > sum(high) or sum(high) > 64:
            continue
        found = packing._exchange(low, high, 64)
        if found:
            assert Counter(found[0]) + Counter(found[1]) == Counter(low) + Counter(high)
            assert sum(found[1]) <= 64
            before, after = (sum(a) ** 2 + sum(b) ** 2 for a, b in ((low, high), found))
            assert after > before


@pytest.mark.parametrize(("n", "want"), [(1, [(0, 1)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (24, [(0, 8), (8, 8), (16, 8)])])
def test_only_the_first_piece_is_short(n, want):
    assert packing.cut(n, 8) == want


def check_places(rows, size):
    fills = defaultdict(list)
    for r in rows:
        fills[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in fills.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(fills)


def test_documents_are_packed_whole(spark, documents):
    rng = random.Random(3)
    texts = ["word " * rng.randint(0, 60) + chr(200 + i % 40) for i in range(400)]
    rows = [*enumerate(texts), (None, None), (7, ""), (7, texts[7]), (900, "<|endoftext|> long " * 300)]
    docs = documents(rows)
    got = packing.pack(spark, docs, size=32, with_ids=True, added=True).collect()
    n = check_places(got, 32)
    total = sum(r["length"] for r in got)
    assert -(-total // 32) <= n <= 1.01 * total / 32 + 1
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for doc_id, text in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        for k, (start, length) in enumerate(packing.cut(len(ids), 32)):
            part = np.array(ids[start : start + length], dtype="<u4").tobytes()
            want[doc_id, k, start, length, zlib.crc32(part), part] += 1
    names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
    assert Counter(tuple(bytes(r[c]) if c == "ids" else r[c] for c in names) for r in got) == want


def test_a_million_blanks(spark, documents):
    text = "word" + "\n" * 1_200_000 + "end"
    got = packing.pack(spark, documents([(1, text), (2, "x")])).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == len(plain.encode(text).ids) + 1
    check_places(got, packing.SEQUENCE)


def test_hot_length_and_empty_table(spark, documents):
    got = packing.pack(spark, documents([(i, "same text here") for i in range(3000)]), size=10)
    rows = got.collect()
    length = rows[0]["length"]
    assert check_places(rows, 10) == -(-3000 // (10 // length))
    assert packing.pack(spark, documents([])).collect() == []


@pytest.mark.parametrize("run", ["query", "pipeline"])
def test_added_tokens_have_their_ids(spark, documents, tmp_path, run):
    name = "<|endoftext|>"
    texts = [f"a {name} b", name, f"{name}{name} x", f"  {name}\n\n y'll {name} ", f"{name[:-1]} >", "plain  text"]
    texts.append(f"word {name}" + "\n" * 1_200_000 + f"{name} end")
    docs = documents(list(enumerate(texts)))
    if run == "query":
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        rows = packing.op9_packing(spark, str(tmp_path)).collect()
    else:
        rows = corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert plain.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    want = Counter()
    for doc_id, text in enumerate(texts):
        ids = plain.encode(text, add_special_tokens=False).ids + [0]
        for k, (start, length) in enumerate(packing.cut(len(ids), packing.SEQUENCE)):
            part = np.array(ids[start : start + length], dtype="<u4").tobytes()
            want[doc_id, k, start, length, zlib.crc32(part)] += 1
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert Counter(tuple(r[c] for c in names) for r in rows) == want
