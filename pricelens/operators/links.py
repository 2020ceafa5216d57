"""All keys and links of a set of tables, checked in one shuffle.

Every table is scanned once and hands out a row (link, key, side) for each key it owns and each
key it points to. One aggregate per link and key then tells how many parent and child rows meet:
repeated parent keys, child rows without a parent, and the first such keys. Rows of a key are
added up in their task, so a key that fills a third of a table is one row by the time it moves.
Whole-number keys are compared as numbers, all others as text, each kind in a shuffle of its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens.functions.numeric import count_if
from pricelens.operators.checks import stacked
from pricelens.operators.shapes import top_per_group

col = F.col


@dataclass(frozen=True)
class Link:
    """A key that should be unique in ``parent``, and the column of ``child`` that points to it.

    Without a child only the key is checked. A key of several columns has no child.
    """

    name: str
    parent: str
    key: tuple[str, ...]
    child: str | None = None
    child_key: str | None = None

    def sides(self) -> list[tuple[str, tuple[str, ...], int]]:
        """(table, columns, whether they are the parent's)."""
        own = [(self.parent, self.key, 1)]
        return own + ([(self.child, (self.child_key,), 0)] if self.child else [])


def _is_whole(tables: Mapping[str, DataFrame], link: Link) -> bool:
    return all(
        len(columns) == 1 and isinstance(tables[table].schema[columns[0]].dataType, T.IntegralType)
        for table, columns, _ in link.sides()
    )


def _cell(columns: Sequence[str], kind: str) -> Column:
    if len(columns) == 1:
        return col(f"`{columns[0]}`").cast(kind)
    return F.to_json(F.struct(*[col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})


def _per_key(tables: Mapping[str, DataFrame], links: Sequence[Link], kind: str) -> DataFrame:
    """link, key, parents, children: rows on either side of every key; a NULL key is one key."""
    uses: dict[str, list[Column]] = {}
    for place, link in enumerate(links):
        if _is_whole(tables, link) == (kind == "long"):
            for table, columns, side in link.sides():
                cell = F.struct(
                    F.lit(place).alias("link"), _cell(columns, kind).alias("key"), F.lit(side).alias("side")
                )
                uses.setdefault(table, []).append(cell)
    cells = [
        tables[table].select(F.explode(F.array(*found)).alias("c")).select("c.*")
        for table, found in uses.items()
    ]
    return (
        stacked(cells)
        .groupBy("link", "key")
        .agg(F.sum("side").alias("parents"), F.sum(1 - col("side")).alias("children"))
        .withColumn("absent", (col("children") > 0) & (col("key").isNull() | (col("parents") == 0)))
    )


def link_counts(
    tables: Mapping[str, DataFrame], links: Sequence[Link], examples: int = 0
) -> DataFrame:
    """One row per link: name, duplicate_rows, duplicate_keys, missing_rows, examples.

    ``duplicate_rows`` are parent rows beyond the first of their key (NULL keys count as equal),
    ``duplicate_keys`` the keys that have such rows, ``missing_rows`` the child rows whose key is NULL
    or has no parent, ``examples`` the first few such keys in text order ('' if not asked for).
    """
    kinds = sorted({"long" if _is_whole(tables, link) else "string" for link in links})
    counts, shown = [], []
    for kind in kinds:
        keys = _per_key(tables, links, kind)
        counts.append(
            keys.groupBy("link").agg(
                F.sum(F.greatest(col("parents") - 1, F.lit(0))).alias("duplicate_rows"),
                count_if(col("parents") > 1).alias("duplicate_keys"),
                F.sum(F.when(col("absent"), col("children")).otherwise(0)).alias("missing_rows"),
            )
        )
        if examples:
            named = keys.where(col("absent") & col("key").isNotNull())
            text = named.select("link", col("key").cast("string").alias("key"))
            first = top_per_group(text, ["link"], [col("key").asc()], examples)
            shown.append(
                first.groupBy("link").agg(
                    F.array_join(F.sort_array(F.collect_list("key")), ", ").alias("examples")
                )
            )
    session = next(iter(tables.values())).sparkSession
    names = F.array(*[F.lit(link.name) for link in links])
    all_ = session.range(len(links)).select(col("id").cast("int").alias("link"))
    found = all_.join(stacked(counts), "link", "left")
    if shown:
        found = found.join(stacked(shown), "link", "left")
    else:
        found = found.withColumn("examples", F.lit(None).cast("string"))
    zero = F.lit(0).cast("long")
    return found.select(
        F.get(names, col("link")).alias("name"),
        *[F.coalesce(c, zero).alias(c) for c in ("duplicate_rows", "duplicate_keys", "missing_rows")],
        F.coalesce("examples", F.lit("")).alias("examples"),
    )


def link_facts(tables: Mapping[str, DataFrame], links: Sequence[Link]) -> DataFrame:
    """The counts of all links as one row: ``links``, a map from the name of a link."""
    counted = link_counts(tables, links)
    figures = F.struct("duplicate_rows", "duplicate_keys", "missing_rows")
    return counted.agg(
        F.map_from_entries(F.collect_list(F.struct("name", figures))).alias("links")
    )


def figure(link: str, name: str) -> Column:
    """A count of one link from ``link_facts``."""
    return col("links")[link][name]
