from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens import policy as P
from pricelens.functions import numeric as N
from pricelens.functions import pricing as X
from pricelens.functions import scoring as S

col = F.col


def values(spark, rows, kind, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {kind}")
    return [r.out for r in frame.select("i", expression.alias("out")).orderBy("i").collect()]


def test_tier_edges(spark):
    scores = [80.0, 79.9, 65.0, 64.9, 45.0, 44.9]
    assert values(spark, scores, "double", S.risk_tier(col("v"))) == [
        "Critical", "High", "High", "Medium", "Medium", "Low",
    ]


def test_excess_and_shortfall(spark):
    excess = S.excess(col("v"), P.Breach(0.2, 0.2))
    assert values(spark, [0.4, 0.9, 0.1, 0.3, None], "double", excess) == pytest.approx(
        [100.0, 100.0, 0.0, 50.0, None]
    )
    assert values(spark, [0.4], "double", S.excess(col("v"), P.Breach(0.2, 0.0))) == [0.0]
    shortfall = S.shortfall(col("v"), P.Breach(0.4, 0.4))
    assert values(spark, [0.0, 0.4, 0.5, 0.2], "double", shortfall) == pytest.approx(
        [100.0, 0.0, 0.0, 50.0]
    )


@pytest.mark.parametrize(
    ("discount", "share", "margin", "expected"),
    [
        (0.10, 0.15, 0.50, "healthy"),
        (0.12, 0.20, 0.45, "healthy"),
        (0.15, 0.25, 0.42, "mixed"),
        (0.18, 0.30, 0.40, "mixed"),
        (0.30, 0.50, 0.30, "reliant"),
    ],
)
def test_verdict_edges(spark, discount, share, margin, expected):
    verdict, reason = S.health_verdict(F.lit(discount), F.lit(share), F.lit(margin))
    row = spark.range(1).select(verdict.alias("v"), reason.alias("r")).first()
    assert (row.v, row.r) == P.VERDICTS[expected]


def test_bucket_edges(spark):
    depths = [0.0, 0.05, 0.0501, 0.10, 0.20, 0.2001, 0.30, 0.31, 1.5, None]
    assert values(spark, depths, "double", X.discount_bucket(col("v"))) == [
        "0-5%", "0-5%", "5-10%", "5-10%", "10-20%", "20-30%", "20-30%", "30%+", "30%+", None,
    ]


def test_flags_treat_null_as_no(spark):
    assert values(spark, [0.2, 0.19, None], "double", X.at_least(col("v"), 0.2)) == [1, 0, 0]


def test_tenure_bands(spark):
    days = [0.0, 1.0, 365.0, 365.5, 730.0, 1095.0, 1460.0, 1461.0, None]
    assert values(spark, days, "double", X.tenure_band(col("v"))) == [
        None, "<1y", "<1y", "1-2y", "1-2y", "2-3y", "3-4y", "4y+", None,
    ]


def test_quarter_and_month(spark):
    days = [dt.date(2024, 1, 31), dt.date(2024, 12, 1)]
    assert values(spark, days, "date", X.order_quarter(col("v"))) == ["2024-Q1", "2024-Q4"]
    assert values(spark, days, "date", X.month_label(col("v"))) == ["2024-01", "2024-12"]


def test_half_even_rounds_like_numpy(spark):
    numbers = [0.125, 0.135, 45.125, 45.135, 2.675, -0.005, -0.001]
    got = values(spark, numbers, "double", N.half_even(col("v"), 2))
    assert got == [float(x) + 0.0 for x in np.round(numbers, 2)]
    assert str(got[-1]) == "0.0"


def test_ratio_fallbacks(spark):
    assert values(spark, [2.0, 0.0, -1.0], "double", N.ratio(F.lit(1.0), col("v"))) == [
        0.5, None, None,
    ]
    assert values(spark, [0.0], "double", N.ratio(F.lit(1.0), col("v"), 0.0)) == [0.0]


def test_clip_keeps_null(spark):
    assert values(spark, [-1.0, 0.5, 2.0, None], "double", N.clip(col("v"), 0, 1)) == [
        0.0, 0.5, 1.0, None,
    ]


def test_driver_ties_go_to_the_first_component(spark):
    rows = [(60.0, 60.0, 60.0), (50.0, 60.0, 60.0), (50.0, 60.0, 61.0)]
    frame = spark.createDataFrame(rows, list(P.COMPONENTS))
    assert [r.d for r in frame.select(S.main_driver().alias("d")).collect()] == list(P.COMPONENTS)


def test_actions(spark):
    cases = [
        ("Low", "pricing_risk_score", "monitor only"),
        ("Medium", "pricing_risk_score", "review segment pricing"),
        ("High", "pricing_risk_score", "review pricing variance"),
        ("Critical", "discount_dependency_score", "review discount terms"),
        ("High", "margin_erosion_score", "review margin guardrails"),
        ("High", "something else", "review segment pricing"),
    ]
    frame = spark.createDataFrame(cases, "t string, d string, want string")
    for row in frame.withColumn("got", S.recommended_action(col("t"), col("d"))).collect():
        assert row.got == row.want
