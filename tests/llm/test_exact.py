from __future__ import annotations

import hashlib

import pytest

from pricelens.llm.exact import drop_exact_copies, exact_groups

ROWS = [(1, "a"), (2, "a"), (3, "b"), (None, "a"), (4, None), (5, ""), (2, "a"), (None, "c")]


def result(frame) -> list[tuple]:
    return sorted(
        ((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in frame.collect()), key=str
    )


def test_largest_stays_and_ties_leave_one(spark, documents):
    got = result(exact_groups(spark, documents(ROWS), keep="largest", fan_in=2))
    a = [r for r in got if r[1] == 2]
    assert [r[2] for r in a] == [4] * 4 and sum(r[3] for r in a) == 1
    assert (1, 2, 4, False) in a and (None, 2, 4, False) in a
    assert (4, 5, 2, False) in got and (5, 5, 2, True) in got
    assert (3, 3, 1, True) in got and (None, None, 1, True) in got


def test_smallest_stays(spark, documents):
    got = result(exact_groups(spark, documents(ROWS), keep="smallest"))
    assert (1, 1, 4, True) in got and (2, 1, 4, False) in got and (None, 1, 4, False) in got


def test_digest_and_empty_table(spark, documents):
    got = exact_groups(spark, documents([(1, "é")])).collect()
    assert got[0]["text_sha256"] == hashlib.sha256("é".encode()).hexdigest()
    assert exact_groups(spark, documents([])).collect() == []
    with pytest.raises(ValueError):
        exact_groups(spark, documents([]), keep="any")


@pytest.mark.parametrize("fan_in", [2, 3, 8])
def test_many_runs_give_the_same_groups(spark, fan_in):
    docs = spark.range(0, 2000, 1, 13).selectExpr(
        "id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id % 400) END AS text"
    )
    got = exact_groups(spark, docs, keep="largest", fan_in=fan_in).collect()
    text = {i: "hot" if i % 3 == 0 else f"t{i % 400}" for i in range(2000)}
    best: dict[str, int] = {}
    for i, t in text.items():
        best[t] = max(best.get(t, -1), i)
    assert len(got) == 2000
    assert all(r["keep_id"] == best[text[r["id"]]] and r["kept"] == (r["id"] == r["keep_id"]) for r in got)


def test_rows_that_stay_keep_their_columns(spark, documents):
    docs = documents(ROWS)
    got = drop_exact_copies(spark, docs, keep="largest")
    assert got.columns == docs.columns
    rows = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert rows == sorted([(2, "a"), (3, "b"), (5, ""), (None, "c")], key=str)
