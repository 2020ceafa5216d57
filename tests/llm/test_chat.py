from __future__ import annotations

import pytest

from pricelens.llm.chat import maximal_conversations
from tests.conftest import local_frame


def chat(spark, rows):
    return local_frame(spark, rows, "conv_id long, turn long, role string, text string, h1 string")


def talk(conv: int, *texts: str) -> list[tuple]:
    return [(conv, i, ("user", "assistant")[i % 2], t, "clash") for i, t in enumerate(texts)]


def test_snapshots_collapse(spark):
    rows = [
        *talk(1, "hi"),
        *talk(2, "hi", "hello"),
        *talk(3, "hi", "hello", "bye"),
        *talk(4, "hi", "other"),
        *talk(5, "hi", "hello", "bye"),
        *talk(6, "hi", "hell"),
    ]
    got = {r["conv_id"]: r for r in maximal_conversations(spark, chat(spark, rows)).collect()}
    assert set(got) == {3, 4, 6}
    assert got[3]["n_copies"] == 2 and got[3]["n_turns"] == 3
    assert got[4]["rendered"] == "<|turn|>user\nhi<|end|>\n<|turn|>assistant\nother<|end|>\n"


def test_borders_between_turns_count(spark):
    rows = [(1, 0, "user", "ab", ""), (2, 0, "user", "a", ""), (2, 1, "user", "b", "")]
    got = maximal_conversations(spark, chat(spark, rows))
    assert {r["conv_id"] for r in got.collect()} == {1, 2}


def test_nulls_ties_and_empty(spark):
    rows = [
        (None, 0, "user", "lost", ""),
        (1, None, None, None, ""),
        (1, 0, "user", "x", ""),
        (1, 0, "user", "x", ""),
        (2, 5, "", "", ""),
    ]
    got = {r["conv_id"]: r for r in maximal_conversations(spark, chat(spark, rows)).collect()}
    assert set(got) == {1}  # conversation 2 is the first turn of 1: unknown role, empty text
    assert got[1]["n_turns"] == 3
    assert got[1]["rendered"].startswith("<|turn|>unknown\n<|end|>\n")
    assert maximal_conversations(spark, chat(spark, [])).collect() == []


@pytest.mark.parametrize("copies", [300])
def test_hot_conversation(spark, copies):
    rows = [t for c in range(copies) for t in talk(c, "same", "turns")] + talk(9999, "same", "turns", "more")
    got = maximal_conversations(spark, chat(spark, rows)).collect()
    assert [(r["conv_id"], r["n_copies"]) for r in got] == [(9999, 1)]
