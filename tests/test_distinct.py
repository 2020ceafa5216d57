from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pricelens.operators.distinct import distinct_counts, least_distinct
from tests.conftest import local_frame

DDL = "a long, b int, d date, x double, s string, `p.q` string, m decimal(12,2), t boolean, w decimal(30,2)"


def rows() -> list[tuple]:
    day = dt.date(1969, 12, 20)
    out = []
    for i in range(1000):
        out.append(
            (
                i - 500, i % 7, day + dt.timedelta(days=i % 30), (i % 100) / 8, f"t{i % 333}", None,
                i % 50, i % 2 == 0, i % 11,
            )
        )
    out += [(None,) * 9, (32768, None, None, -0.0, "", None, None, None, None), (-32768, 0, None, 0.0, "é", None, None, None, None)]
    return out


@pytest.fixture
def frame(spark):
    cast = [(*r[:6], r[6], r[7], r[8]) for r in rows()]
    from decimal import Decimal

    fixed = [tuple(Decimal(v) if i in (6, 8) and v is not None else v for i, v in enumerate(r)) for r in cast]
    return local_frame(spark, fixed, DDL)


@pytest.mark.parametrize("dense", [set(), {"a", "b", "d"}, {"a"}])
def test_counts_are_those_of_the_values(frame, dense):
    names = frame.columns
    got = {r["column_name"]: r["distinct_count"] for r in distinct_counts(frame, names, dense).collect()}
    exact = frame.agg(*[F.countDistinct(F.col(f"`{n}`")).alias(n) for n in names]).first().asDict()
    assert got == exact
    assert got["p.q"] == 0 and got["x"] == 100


def test_long_range_of_bits(spark):
    frame = spark.range(0, 400_000, 3).selectExpr("id - 200000 AS k", "id % 5 AS five")
    got = {r[0]: r[1] for r in distinct_counts(frame, ["k", "five"], {"k", "five"}).collect()}
    assert got == {"k": 133_334, "five": 5}


def test_at_most_two_scans(spark, tmp_path):
    spark.range(50).selectExpr("id AS k", "id * 1.5 AS x", "cast(id AS string) AS s", "id % 3 AS m").write.parquet(
        str(tmp_path / "t")
    )
    found = distinct_counts(spark.read.parquet(str(tmp_path / "t")), ["k", "x", "s", "m"], {"k", "m"})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 2


def test_empty_table_and_no_column(spark, frame):
    got = distinct_counts(frame.where("false"), ["a", "s"], {"a"}).collect()
    assert {(r[0], r[1]) for r in got} == {("a", 0), ("s", 0)}
    with pytest.raises(ValueError):
        distinct_counts(frame, [])


def test_least_distinct_is_never_more_than_the_count(spark):
    kinds = [(0.0, 0), (-0.0, 1), (None, None)] + [(float(i), i % 3) for i in range(500)]
    table = local_frame(spark, kinds, "x double, b int")
    found = table.agg(least_distinct(F.col("x")).alias("x"), least_distinct(F.col("b")).alias("b")).first()
    assert 5 < found.x <= 64 and 1 <= found.b <= 3
    one = table.where("x = 0").agg(least_distinct(F.col("x")), least_distinct(F.lit(None).cast("double"))).first()
    assert tuple(one) == (1, 0)
