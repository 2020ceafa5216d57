from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from pricelens.llm import phrases
from pricelens.llm.phrases import collocations, phrase_counts
from tests.conftest import local_frame

DDL = "doc_id long, text string, lang string, prefix string, n long"


def docs_of(spark, rows: list[tuple]):
    """Rows of (text, lang), with columns whose names clash with those of the operator."""
    return local_frame(spark, [(i, t, g, "x", 1) for i, (t, g) in enumerate(rows)], DDL)


def words_of(text: str | None) -> list[list[str]]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^ \t]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def counted(rows: list[tuple], longest: int) -> dict[str, Counter]:
    found: dict[str, Counter] = defaultdict(Counter)
    for text, lang in rows:
        for words in words_of(text):
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    found["und" if lang is None else lang][tuple(words[i : i + m])] += 1
    return found


def plain(rows: list[tuple], longest: int, least: int, most: int) -> set[tuple]:
    out = set()
    for lang, f in counted(rows, longest).items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        chosen = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = set()
        for p, a in chosen.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    if 100 * a >= 50 * f[p[i : i + m]]:
                        dropped.add(p[i : i + m])
        scored = []
        for p, a in chosen.items():
            if p not in dropped:
                cuts = [(10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:most], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n, -score))
    return out


def corpus(seed: int, size: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["the", "New", "york", "É", "a", "b-c", "naïve", "x y", "of", "|"]
    rows: list[tuple] = [(None, "en"), ("", None), (" \t ", "en"), (".,;\x0b\x0c\r", "fr")]
    for _ in range(size):
        text = "".join(
            rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"])
            for _ in range(rng.randrange(60))
        )
        rows.append((text, rng.choice(["en", "en", "fr", None])))
    return rows


def result(frame) -> set[tuple]:
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("budget,group", [(1 << 18, 1 << 21), (20, 50), (1, 1)])
@pytest.mark.parametrize("longest", [2, 3, 4])
def test_same_as_plain_counting_at_any_budget(spark, monkeypatch, budget, group, longest):
    rows = corpus(longest, 60)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 500)
    got = collocations(spark, docs_of(spark, rows), longest, least=3, most=40, budget=budget, group=group)
    assert result(got) == plain(rows, longest, 3, 40)


def test_extended_prefixes_keep_their_totals(spark):
    rows = corpus(7, 40)
    for budget in (1, 10_000):
        nodes, languages = phrase_counts(spark, docs_of(spark, rows), 3, least=1, budget=budget, group=30)
        want = {(g, " ".join(p), len(p), n) for g, f in counted(rows, 3).items() for p, n in f.items()}
        assert result(nodes) == want
        totals = {g: sum(n for p, n in f.items() if len(p) == 1) for g, f in counted(rows, 3).items()}
        assert {g: n for g, n in result(languages)} == totals


def test_a_word_that_fills_a_third_of_the_corpus(spark):
    rows = [("hot hot hot w%d hot v%d" % (i % 50, i % 7), "en") for i in range(300)]
    got = collocations(spark, docs_of(spark, rows), least=10, budget=5, group=20)
    assert result(got) == plain(rows, 3, 10, 2000)


def test_a_very_long_text_is_cut_at_piece_ends(spark):
    text = " ".join(f"w{i % 97} w{i % 31}" + (". " if i % 50 == 0 else "") for i in range(60_000))
    rows = [(text, "en"), ("word" * 50_000, "en")]
    assert result(collocations(spark, docs_of(spark, rows))) == plain(rows, 3, 10, 2000)


def test_ties_go_to_the_smaller_phrase(spark):
    rows = [("b b2. a a2. é é2. z z2", "en")] * 10
    got = sorted(result(collocations(spark, docs_of(spark, rows), most=3)))
    assert [(r[1], r[2], r[7]) for r in got] == [(1, "a a2", 10**6), (2, "b b2", 10**6), (3, "z z2", 10**6)]


def test_products_beyond_64_bits_are_exact(spark):
    nodes = spark.createDataFrame([(3_000_000_011, 4_000_000_007)], "a long, r long")
    a, r = (nodes[c].cast("decimal(15,0)") for c in "ar")
    up = (a * a * phrases.F.lit(1_000_000).cast("decimal(7,0)")).alias("up")
    row = nodes.select(up, (a * r).alias("down")).selectExpr("up div down AS score", "up").first()
    assert int(row["up"]) == 3_000_000_011**2 * 10**6
    assert row["score"] == 3_000_000_011**2 * 10**6 // (3_000_000_011 * 4_000_000_007)


def test_empty_table_and_arguments(spark):
    empty = docs_of(spark, [("a b", "en")]).where("false")
    assert collocations(spark, empty).collect() == []
    with pytest.raises(ValueError):
        collocations(spark, empty, max_words=1)
