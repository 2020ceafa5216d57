"""Staging models: project, cast and drop rows without a primary key."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.sources import contract as C


def staged_table(raw: DataFrame, contract: C.TableContract) -> DataFrame:
    """Contract columns, measures and dates cast; rows with a NULL key part are dropped.

    Text that does not parse becomes NULL here; the raw checks report it beforehand.
    """
    given = {field.name: field.dataType for field in raw.schema.fields}
    typed = []
    for name in contract.columns:
        target = contract.measured.get(name, given[name])
        source = F.col(name)
        typed.append(source if given[name] == target else source.try_cast(target).alias(name))
    staged = raw.select(*typed)
    for key in contract.key:
        staged = staged.where(F.col(key).isNotNull())
    return staged


def staged_tables(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """All five staging models; the rep's region is renamed to keep it apart."""
    C.require_raw_tables(raw)
    out = {name: staged_table(raw[name], spec) for name, spec in C.RAW.items()}
    out["sales_reps"] = out["sales_reps"].withColumnRenamed("region", "rep_region")
    return out
