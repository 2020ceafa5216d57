from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import pytest

from pricelens.llm import variants
from pricelens.llm.variants import disjoint_grams, near_words, spelling_variants, word_counts
from tests.conftest import local_frame


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i:]


def frame(spark, words: dict[str, int]):
    return local_frame(spark, list(words.items()), "word string, n long")


def pairs_of(frame) -> set[tuple]:
    rows = [(r["word"], r["other"], r["other_n"]) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def plain_pairs(words: dict[str, int]) -> set[tuple]:
    return {(a, b, n) for a in words for b, n in words.items() if one_edit(a, b)}


def plain_variants(words: dict[str, int], times: int = 10) -> set[tuple]:
    near: dict[str, list] = {w: [] for w in words}
    for w, other, n in plain_pairs(words):
        near[w].append((-n, other))
    form = {w: None for w in words}
    for w, found in near.items():
        if found and -min(found)[0] >= times * words[w]:
            form[w] = min(found)[1]
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_all_pairs_over_few_letters(spark, seed):
    """Few letters: prefixes with many ties, bigrams that repeat, edits at both ends."""
    rng = random.Random(seed)
    letters = "ab" if seed < 2 else "abcéÿ"
    words = {"".join(rng.choices(letters, k=rng.randrange(4, 9))): rng.randrange(1, 99) for _ in range(220)}
    assert pairs_of(near_words(spark, frame(spark, words))) == plain_pairs(words)


def test_every_edit_of_a_word_is_found(spark):
    word = "pivotalgrams"
    words = {word: 1000}
    for i in range(len(word) + 1):
        words[word[:i] + "q" + word[i:]] = 5
        if i < len(word):
            words[word[:i] + "z" + word[i + 1 :]] = 5
            words[word[:i] + word[i + 1 :]] = 5
    got = pairs_of(near_words(spark, frame(spark, words)))
    assert got == plain_pairs(words)
    assert sum(w == word for w, _, _ in got) == len(words) - 1


@pytest.mark.parametrize("length", [62, 63, 64, 65, 300, 100_000])
def test_words_beyond_the_length_of_words(spark, length):
    """Runs of one letter and of random letters, around the length from which halves are used."""
    rng = random.Random(length)
    base = "".join(rng.choices("abcdefgh", k=length))
    words = {base: 9, "a" * length: 9, "a" * (length + 1): 9, "a" * (length - 1): 9}
    for i in (0, length // 2, length - 1):
        words[base[:i] + "x" + base[i + 1 :]] = 2
        words[base[:i] + base[i + 1 :]] = 2
        words[base[:i] + "x" + base[i:]] = 2
    assert pairs_of(near_words(spark, frame(spark, words))) == plain_pairs(words)


def test_forms_roots_and_ties(spark):
    words = {"abcdefg": 1, "abcdefgh": 10, "abcdefghi": 1000, "xbcdefg": 10, "abcdefgx": 9, "lonelyword": 3}
    rows = {tuple(r) for r in spelling_variants(spark, frame(spark, words)).collect()}
    assert rows == plain_variants(words)
    by = {r[0]: r for r in rows}
    assert by["abcdefg"][1:3] == ("abcdefgh", "abcdefghi")  # a tie with xbcdefg, then a chain
    assert by["lonelyword"] == ("lonelyword", None, "lonelyword", 3, 0, None)
    with pytest.raises(ValueError):
        spelling_variants(spark, frame(spark, words), times=1)


def test_long_chains_end_at_their_root(spark):
    words = {"abcdefgh"[: 4 + i] + "z" * 0: 10**i for i in range(5)}
    rows = {tuple(r) for r in spelling_variants(spark, frame(spark, words)).collect()}
    assert rows == plain_variants(words) and {r[2] for r in rows} == {"abcdefgh"}


def test_a_third_of_all_words_are_near_one(spark):
    base = "grammarian"
    letters = "abcdefghijklmnopqrstuvwxyzàáâãäåæç"
    words = {base: 5000} | {base[:i] + c + base[i + 1 :]: 2 for i in range(10) for c in letters if c != base[i]}
    words |= {f"unrelated{chr(97 + i)}{chr(97 + j)}x": 2 for i in range(20) for j in range(20)}
    rows = {tuple(r) for r in spelling_variants(spark, frame(spark, words)).collect()}
    assert rows == plain_variants(words)


def test_word_counts_of_runs(spark, documents):
    docs = documents([(1, "ABCDEFGÉ abcdefgÉ abcdefgé"), (None, "abcdefgÉ×÷-Short"), (3, None), (4, "")])
    got = {(r["word"], r["n"]) for r in word_counts(docs, least=1).collect()}
    assert got == {("abcdefgÉ", 2), ("abcdefgé", 1), ("abcdefgÉ×÷", 1)}
    assert word_counts(docs, least=2).collect()[0]["n"] == 2
    assert spelling_variants(spark, word_counts(documents([]))).collect() == []


def test_very_long_texts_and_repeated_rows(spark, documents):
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcd", k=8)) for _ in range(30_000))
    docs = documents([(1, text), (1, text), (2, "zzzzzzz")])
    want = Counter(re.findall("[a-z]{7,}", text))
    got = {r["word"]: r["n"] for r in word_counts(docs).collect()}
    assert got == {w: 2 * n for w, n in want.items()}


def test_short_words_are_near_to_none(spark):
    rows = spelling_variants(spark, frame(spark, {"abc": 50, "abcd": 5, "abd": 1})).collect()
    assert {(r["word"], r["n_near"]) for r in rows} == {("abc", 0), ("abcd", 0), ("abd", 0)}


def test_pivots_are_the_cheapest_disjoint_grams():
    rng = random.Random(3)
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randrange(2, 8)))
        costs = [rng.randrange(1, 9) for _ in places]
        price = dict(zip(places, costs, strict=True))
        for picks in (1, 2, 3):
            got = disjoint_grams(places, costs, picks)
            able = [
                c for c in combinations(places, picks) if all(b - a >= 2 for a, b in zip(c, c[1:], strict=False))
            ]
            if not able:
                assert got == ()
                continue
            assert got in able
            assert sum(price[p] for p in got) == min(sum(price[p] for p in c) for c in able)


def test_query_key_is_the_crc_of_identifier_and_run(spark, documents):
    import zlib

    words = [f"respelled{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    want = Counter()
    for w in words:
        h = zlib.crc32(f"7:{w}".encode())
        want[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    docs = documents([(7, " ".join(words))])
    got = word_counts(docs, least=1, respelled=variants._thinned).collect()
    assert {r["word"]: r["n"] for r in got} == want and any(len(w) == 10 for w in want)
