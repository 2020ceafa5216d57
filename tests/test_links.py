from __future__ import annotations

import pytest

from pricelens.operators.links import Link, figure, link_counts, link_facts
from tests.conftest import local_frame


@pytest.fixture
def tables(spark):
    parents = [(1, "a"), (2, "b"), (2, "b"), (None, None), (None, None), (None, "c")]
    children = [(1, "a", 1), (1, "z", 2), (9, "z", 2), (9, "y", 3), (None, None, 4), (2, "b", 5)]
    hot = [(7, "hot", 0)] * 500
    return {
        "parent": local_frame(spark, parents, "id long, code string"),
        "child": local_frame(spark, children + hot, "parent_id int, code string, `a.b` long"),
        "empty": local_frame(spark, [], "id long, code string"),
    }


def counted(frame) -> dict:
    return {
        r["name"]: (r["duplicate_rows"], r["duplicate_keys"], r["missing_rows"], r["examples"])
        for r in frame.collect()
    }


def test_numbers_text_and_composite_keys_together(tables):
    links = [
        Link("by_id", "parent", ("id",), "child", "parent_id"),
        Link("by_code", "parent", ("code",), "child", "code"),
        Link("mixed", "parent", ("code",), "child", "parent_id"),
        Link("both", "parent", ("id", "code")),
        Link("dotted", "child", ("a.b",)),
        Link("to_empty", "empty", ("id",), "child", "parent_id"),
        Link("from_empty", "parent", ("id",), "empty", "id"),
        Link("empty", "empty", ("id",)),
    ]
    got = counted(link_counts(tables, links, examples=2))
    assert got == {
        "by_id": (3, 2, 503, "7, 9"),
        "by_code": (2, 2, 504, "hot, y"),
        "mixed": (2, 2, 506, "1, 2"),
        "both": (2, 2, 0, ""),
        "dotted": (500, 2, 0, ""),
        "to_empty": (0, 0, 506, "1, 2"),
        "from_empty": (3, 2, 0, ""),
        "empty": (0, 0, 0, ""),
    }


def test_facts_are_one_row(tables):
    links = [Link("by_id", "parent", ("id",), "child", "parent_id"), Link("codes", "parent", ("code",))]
    row = link_facts(tables, links).select(
        figure("by_id", "missing_rows").alias("a"), figure("codes", "duplicate_rows").alias("b")
    )
    assert [tuple(r) for r in row.collect()] == [(503, 2)]


def test_one_shuffle_of_keys_for_links_of_one_kind(tables):
    links = [
        Link("by_id", "parent", ("id",), "child", "parent_id"),
        Link("twice", "parent", ("id",), "child", "parent_id"),
        Link("keys", "empty", ("id",)),
    ]
    plan = link_counts(tables, links)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(link#") <= 3  # keys, their counts, and the list of links
