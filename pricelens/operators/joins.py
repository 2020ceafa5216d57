"""Joins with a stated cardinality, and the checks that prove it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.operators.links import Link, link_counts

col = F.col


def orphan_count(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """One row, ``missing_rows``: child rows whose key is NULL or absent from the parent.

    Child rows are counted per key before the anti join, so a hot key is one row by the
    time it is shuffled to the parent.
    """
    per_key = child.groupBy(col(child_key).alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    keys = parent.select(col(parent_key).alias("key"))
    absent = per_key.join(keys, "key", "left_anti")
    return absent.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("missing_rows"))


def duplicate_count(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row, ``duplicates``: rows beyond the first of each key (NULL keys count as equal).

    Only the keys are shuffled; other checks of the table run in their own aggregate, so
    that their buffers do not travel with every key.
    """
    per_key = table.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("extra"))
    return per_key.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicates"))


def link_violations(
    left: DataFrame, right: DataFrame, key: str, dimension: str, examples: int = 5
) -> DataFrame:
    """Breaches of a many-to-one link: duplicate dimension keys and unmatched left rows.

    One row with ``dimension, join_key, duplicate_keys, unmatched_rows, examples``; the
    examples are the first few unmatched keys in text order.
    """
    link = Link(dimension, "right", (key,), "left", key)
    return violations({"left": left, "right": right}, [link], examples)


def violations(
    tables: Mapping[str, DataFrame], links: Sequence[Link], examples: int = 5
) -> DataFrame:
    """``link_violations`` of several links at once; a link is named by its dimension."""
    keys = F.create_map(*[F.lit(part) for link in links for part in (link.name, link.child_key)])
    return link_counts(tables, links, examples).select(
        col("name").alias("dimension"),
        keys[col("name")].alias("join_key"),
        "duplicate_keys",
        col("missing_rows").alias("unmatched_rows"),
        "examples",
    )


def assert_many_to_one(left: DataFrame, right: DataFrame, key: str, dimension: str) -> None:
    """Raise ``ValueError`` when the link is broken; starts one job."""
    row = link_violations(left, right, key, dimension).first()
    if row.duplicate_keys:
        raise ValueError(f"{dimension}: {row.duplicate_keys} values of {key} are not unique")
    if row.unmatched_rows:
        raise ValueError(
            f"{dimension}: {row.unmatched_rows} rows have no match on {key}, such as {row.examples}"
        )
