"""Check reports: one row per rule, built from one-row facts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status(passed: Column) -> Column:
    """PASS or FAIL; an unknown outcome is a failure."""
    return F.when(F.coalesce(passed, F.lit(False)), "PASS").otherwise("FAIL")


def as_rows(facts: DataFrame, rows: Iterable[dict[str, Column | str | bool]]) -> DataFrame:
    """Turn a one-row frame into one row per dict; every dict has the same keys."""
    structs = [
        F.struct(
            *[
                (value if isinstance(value, Column) else F.lit(value)).alias(name)
                for name, value in row.items()
            ]
        )
        for row in rows
    ]
    return facts.select(F.explode(F.array(*structs)).alias("row")).select("row.*")


def stacked(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def counted(name: str, failed: Column, detail: Column | str) -> dict[str, Column | str]:
    """A rule that passes when no row fails it."""
    return {
        "check_name": name,
        "status": status(failed == 0),
        "failed_rows": failed.cast("long"),
        "detail": detail,
    }


def judged(name: str, passed: Column, detail: Column | str) -> dict[str, Column | str]:
    """A rule on a single outcome; failing counts as one row."""
    return {
        "check_name": name,
        "status": status(passed),
        "failed_rows": F.when(F.coalesce(passed, F.lit(False)), 0).otherwise(1).cast("long"),
        "detail": detail,
    }


def text(template: str, *values: Column) -> Column:
    return F.format_string(template, *values)
