"""Customer risk scores and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens import policy as P
from pricelens.functions import scoring as S
from pricelens.operators.ordered import percentile_ranks
from pricelens.sources.area import StagingArea

col = F.col

SCORE_COLUMNS = (
    "customer_id",
    "segment",
    "region",
    "company_size",
    "total_orders",
    "total_revenue",
    "avg_discount_pct",
    "weighted_discount_pct",
    "share_orders_discounted",
    "share_orders_high_discount",
    "revenue_high_discount_share",
    "avg_margin_proxy_pct",
    "pricing_risk_score",
    "discount_dependency_score",
    "margin_erosion_score",
    "governance_priority_score",
    "score_reliability_weight",
    "low_data_flag",
    "risk_tier",
    "main_risk_driver",
    "recommended_action",
)


def signals(
    area: StagingArea, profile: DataFrame, policy: P.Policy = P.POLICY
) -> DataFrame:
    """The profile with ``rel_<signal>`` (peer rank) and ``abs_<signal>`` (policy breach)."""
    metrics = list(P.SIGNALS.values())
    ranks = percentile_ranks(area, profile, ["customer_id"], metrics, digits=P.SUM_DIGITS)
    joined = profile.join(ranks, "customer_id", "left")
    columns: dict[str, Column] = {}
    for signal, metric in P.SIGNALS.items():
        columns[f"rel_{signal}"] = S.relative_score(
            col(f"{metric}_rank"), col(f"{metric}_distinct"), signal in P.LOW_IS_RISK
        )
        columns[f"abs_{signal}"] = S.breach_score(signal, policy)
    return joined.select(*profile.columns, *[c.alias(n) for n, c in columns.items()])


def raw_components(with_signals: DataFrame, policy: P.Policy = P.POLICY) -> DataFrame:
    """Add the blended components before shrinkage as ``raw_<component>``."""
    relative = {s: col(f"rel_{s}") for s in P.SIGNALS}
    absolute = {s: col(f"abs_{s}") for s in P.SIGNALS}
    return with_signals.withColumns(
        {f"raw_{name}": S.blended(b, relative, absolute) for name, b in policy.components.items()}
    )


def component_scores(with_signals: DataFrame, policy: P.Policy = P.POLICY) -> DataFrame:
    """Add reliability and the unrounded component and priority scores."""
    weight = S.reliability(col("total_orders"), policy)
    shrunk = {
        name: S.shrink(col(f"raw_{name}"), col("score_reliability_weight"))
        for name in P.COMPONENTS
    }
    return (
        raw_components(with_signals, policy)
        .withColumn("score_reliability_weight", weight)
        .withColumn("low_data_flag", (col("total_orders") < policy.min_reliable_orders).cast("int"))
        .withColumns(shrunk)
        .withColumn(
            "governance_priority_score", S.priority({n: col(n) for n in P.COMPONENTS}, policy)
        )
    )


def classified(unrounded: DataFrame, policy: P.Policy = P.POLICY) -> DataFrame:
    """Round the scores to 2 places, then derive tier, driver and action from them."""
    names = [*P.COMPONENTS, "governance_priority_score", "score_reliability_weight"]
    return (
        unrounded.withColumns({name: S.score2(col(name)) for name in names})
        .withColumns(
            {
                "risk_tier": S.risk_tier(col("governance_priority_score"), policy),
                "main_risk_driver": S.main_driver(),
            }
        )
        .withColumn(
            "recommended_action", S.recommended_action(col("risk_tier"), col("main_risk_driver"))
        )
    )


def scored(area: StagingArea, profile: DataFrame, policy: P.Policy = P.POLICY) -> DataFrame:
    """The full score table, one row per profiled customer."""
    components = component_scores(signals(area, profile, policy), policy)
    return classified(components, policy).select(*SCORE_COLUMNS)


def tier_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("risk_tier", "recommended_action").agg(
        F.count("customer_id").alias("customers"),
        F.sum("total_revenue").alias("total_revenue"),
        F.avg("governance_priority_score").alias("avg_governance_priority"),
    )


def driver_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("main_risk_driver").agg(
        F.count("customer_id").alias("customers"),
        F.sum("total_revenue").alias("total_revenue"),
        F.avg("governance_priority_score").alias("avg_priority"),
    )


def tier_detail(scores: DataFrame) -> DataFrame:
    total = F.sum("revenue").over(Window.partitionBy())  # over the four tiers
    return (
        scores.groupBy("risk_tier")
        .agg(
            F.count("customer_id").alias("customers"),
            F.sum("total_revenue").alias("revenue"),
            F.avg("avg_discount_pct").alias("avg_discount_pct"),
            F.avg("avg_margin_proxy_pct").alias("avg_margin_proxy_pct"),
            F.avg("revenue_high_discount_share").alias("revenue_high_discount_share"),
            F.avg("governance_priority_score").alias("avg_priority"),
        )
        .withColumn("revenue_share", col("revenue") / total)
    )


def review_queue(scores: DataFrame, rows: int = P.REVIEW_QUEUE_ROWS) -> DataFrame:
    """Every Critical and High account, filled up to ``rows`` with the best of the rest.

    The upper tiers are never cut. The fill is a top-k of at most ``rows`` accounts, from
    which the places left over by the upper tiers are taken.
    """
    upper = col("risk_tier").isin(*P.PRIORITY_TIERS)
    by_score = [col("governance_priority_score").desc(), col("customer_id")]
    places = scores.where(upper).agg(F.greatest(F.lit(rows) - F.count(F.lit(1)), F.lit(0))).scalar()
    place = F.row_number().over(Window.orderBy(*by_score))  # over at most ``rows`` accounts
    rest = scores.where(~upper).orderBy(*by_score).limit(rows).withColumn("_place", place)
    return scores.where(upper).unionByName(rest.where(col("_place") <= places).drop("_place"))
