"""Customer risk expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelens import policy as P
from pricelens.functions.numeric import clip, half_even

col = F.col


def excess(value: Column, breach: P.Breach) -> Column:
    """0 at the threshold, 100 once the value lies ``span`` above it."""
    return _scaled(value - F.lit(breach.threshold), breach.span)


def shortfall(value: Column, breach: P.Breach) -> Column:
    """0 at the threshold, 100 once the value lies ``span`` below it."""
    return _scaled(F.lit(breach.threshold) - value, breach.span)


def _scaled(distance: Column, span: float) -> Column:
    if span <= 0:
        return F.lit(0.0)
    floored = F.when(distance.isNotNull(), F.greatest(distance, F.lit(0.0)))
    return clip(floored / F.lit(span) * F.lit(100.0), 0, 100)


def breach_score(signal: str, policy: P.Policy = P.POLICY) -> Column:
    value = col(P.SIGNALS[signal])
    scale = shortfall if signal in P.LOW_IS_RISK else excess
    return scale(value, policy.breaches[signal])


def relative_score(rank: Column, distinct: Column, low_is_risk: bool) -> Column:
    """Peer percentile on 0..100; neutral for missing values or an undifferentiated peer set."""
    position = (F.lit(1.0) - rank) if low_is_risk else rank
    score = F.coalesce(clip(position * 100, 0, 100), F.lit(P.NEUTRAL_SCORE))
    return F.when(distinct <= 1, F.lit(P.NEUTRAL_SCORE)).otherwise(score)


def blended(blend: P.Blend, relative: dict[str, Column], absolute: dict[str, Column]) -> Column:
    def part(weights: dict[str, float], scores: dict[str, Column]) -> Column:
        terms = [F.lit(weight) * scores[signal] for signal, weight in weights.items()]
        return reduce(Column.__add__, terms)

    return F.lit(blend.relative_weight) * part(blend.relative, relative) + F.lit(
        blend.absolute_weight
    ) * part(blend.absolute, absolute)


def reliability(orders: Column, policy: P.Policy = P.POLICY) -> Column:
    return clip(orders / F.lit(float(policy.min_reliable_orders)), 0, 1)


def shrink(raw: Column, weight: Column) -> Column:
    """Pull a score towards neutral by the missing part of its reliability."""
    return weight * raw + (F.lit(1.0) - weight) * F.lit(P.NEUTRAL_SCORE)


def priority(scores: dict[str, Column], policy: P.Policy = P.POLICY) -> Column:
    terms = [F.lit(weight) * scores[name] for name, weight in policy.priority_weights.items()]
    return reduce(Column.__add__, terms)


def score2(value: Column) -> Column:
    return half_even(value, 2)


def risk_tier(score: Column, policy: P.Policy = P.POLICY) -> Column:
    lower, name = policy.tiers[0]
    tier = F.when(score >= lower, name)
    for lower, name in policy.tiers[1:]:
        tier = tier.when(score >= lower, name)
    return tier.otherwise(P.LOWEST_TIER)


def main_driver() -> Column:
    """Highest component; ties go to the earlier one in policy order."""
    names = list(P.COMPONENTS)
    top = F.greatest(*[col(name) for name in names])
    driver = F.when(col(names[0]) == top, names[0])
    for name in names[1:]:
        driver = driver.when(col(name) == top, name)
    return driver


def recommended_action(tier: Column, driver: Column) -> Column:
    action = F.when(tier == P.LOWEST_TIER, P.LOW_ACTION).when(tier == "Medium", P.MEDIUM_ACTION)
    for name, label in P.DRIVER_ACTIONS.items():
        action = action.when(driver == name, label)
    return action.otherwise(P.MEDIUM_ACTION)


def health_verdict(
    discount: Column, high_share: Column, margin: Column, policy: P.Policy = P.POLICY
) -> tuple[Column, Column]:
    """Verdict and reason text for a portfolio row."""

    def inside(band: P.Band) -> Column:
        return (
            (discount <= band.discount_max)
            & (high_share <= band.high_share_max)
            & (margin >= band.margin_min)
        )

    def pick(position: int) -> Column:
        return (
            F.when(inside(policy.healthy), P.VERDICTS["healthy"][position])
            .when(inside(policy.mixed), P.VERDICTS["mixed"][position])
            .otherwise(P.VERDICTS["reliant"][position])
        )

    return pick(0), pick(1)


def watch_level(value: Column, watch: P.Watch) -> Column:
    return (
        F.when(value >= watch.critical, "critical").when(value >= watch.warn, "warn").otherwise("ok")
    )
