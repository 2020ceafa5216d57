"""Governance policy: every threshold, weight and label the plans use.

All values are plain literals, so Catalyst folds them into the expressions.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields


@dataclass(frozen=True)
class Band:
    """Outer limits of one pricing-health verdict."""

    discount_max: float
    high_share_max: float
    margin_min: float


@dataclass(frozen=True)
class Breach:
    """Where an absolute component starts to count and over which range it reaches 100."""

    threshold: float
    span: float


@dataclass(frozen=True)
class Blend:
    """One risk component: a peer-relative part and a policy-breach part.

    ``relative`` and ``absolute`` map a signal name to its weight within the part.
    """

    relative_weight: float
    relative: dict[str, float]
    absolute_weight: float
    absolute: dict[str, float]


@dataclass(frozen=True)
class Watch:
    """Warning and critical line of one dashboard indicator."""

    warn: float
    critical: float


# Line flags and margin guard.
DISCOUNTED_THRESHOLD = 0.05
HIGH_DISCOUNT_THRESHOLD = 0.20
MARGIN_AT_RISK_MAX = 0.35
SENSITIVITY_THRESHOLDS = (0.15, 0.20, 0.25)
DISCOUNT_MAX = 0.7
DISCOUNT_TOLERANCE = 1e-4

# Discount buckets as (upper bound, label); the last one is open.
DISCOUNT_BUCKETS = ((0.05, "0-5%"), (0.10, "5-10%"), (0.20, "10-20%"), (0.30, "20-30%"))
LAST_DISCOUNT_BUCKET = "30%+"

# Tenure bands in days as (upper bound, label), the first one opens above 0.
TENURE_BANDS = ((365, "<1y"), (730, "1-2y"), (1095, "2-3y"), (1460, "3-4y"), (99999, "4y+"))

# Pricing-health verdicts.
HEALTHY = Band(discount_max=0.12, high_share_max=0.20, margin_min=0.45)
MIXED = Band(discount_max=0.18, high_share_max=0.30, margin_min=0.40)
VERDICTS = {
    "healthy": (
        "Healthy pricing discipline",
        "Discount intensity and margin proxy remain within the configured healthy thresholds.",
    ),
    "mixed": (
        "Mixed pricing quality",
        "At least one pricing-health metric falls outside the healthy range"
        " but remains within mixed thresholds.",
    ),
    "reliant": (
        "Discount-reliant growth risk",
        "At least one pricing-health metric falls outside the configured mixed thresholds.",
    ),
}

# Customer risk scoring.
MIN_RELIABLE_ORDERS = 6
NEUTRAL_SCORE = 50.0
HIGH_REVENUE_SHARE_THRESHOLD = 0.40

SIGNALS = {
    "depth": "weighted_discount_pct",
    "residual": "avg_abs_price_realization_residual_pct",
    "order_share": "share_orders_high_discount",
    "revenue_share": "revenue_high_discount_share",
    "repeat": "repeat_discount_behavior",
    "margin": "avg_margin_proxy_pct",
}
LOW_IS_RISK = frozenset({"margin"})

BREACHES = {
    "depth": Breach(0.18, 0.20),
    "residual": Breach(0.075, 0.125),
    "order_share": Breach(0.35, 0.65),
    "revenue_share": Breach(HIGH_REVENUE_SHARE_THRESHOLD, 0.60),
    "repeat": Breach(0.20, 0.80),
    "margin": Breach(0.38, 0.38),
}

COMPONENTS = {
    "pricing_risk_score": Blend(
        0.60,
        {"depth": 0.50, "residual": 0.30, "order_share": 0.20},
        0.40,
        {"depth": 0.45, "residual": 0.30, "order_share": 0.25},
    ),
    "discount_dependency_score": Blend(
        0.55,
        {"revenue_share": 0.45, "repeat": 0.35, "order_share": 0.20},
        0.45,
        {"revenue_share": 0.45, "repeat": 0.30, "order_share": 0.25},
    ),
    "margin_erosion_score": Blend(
        0.50,
        {"margin": 0.55, "depth": 0.30, "revenue_share": 0.15},
        0.50,
        {"margin": 0.55, "depth": 0.25, "revenue_share": 0.20},
    ),
}
PRIORITY_WEIGHTS = {
    "pricing_risk_score": 0.40,
    "discount_dependency_score": 0.35,
    "margin_erosion_score": 0.25,
}
TIERS = ((80.0, "Critical"), (65.0, "High"), (45.0, "Medium"))
LOWEST_TIER = "Low"
TIERS_ASCENDING = ("Low", "Medium", "High", "Critical")
PRIORITY_TIERS = ("Critical", "High")
DRIVER_ACTIONS = {
    "pricing_risk_score": "review pricing variance",
    "discount_dependency_score": "review discount terms",
    "margin_erosion_score": "review margin guardrails",
}
MEDIUM_ACTION = "review segment pricing"
LOW_ACTION = "monitor only"
ACTIONS = (LOW_ACTION, MEDIUM_ACTION, *DRIVER_ACTIONS.values())
ACTIONS_BY_TIER = {
    "Low": (LOW_ACTION,),
    "Medium": (MEDIUM_ACTION,),
    "High": (*DRIVER_ACTIONS.values(), MEDIUM_ACTION),
    "Critical": (*DRIVER_ACTIONS.values(), MEDIUM_ACTION),
}

# Diagnostic heuristics.
TOP_DEPENDENCY_SHARE = 0.10
MIN_REP_LINES = 120
REP_OUTLIER_Z = 2.0
MIN_PRODUCT_CHANNEL_LINES = 25
EROSION_WEIGHTS = {"discount": 0.45, "high_share": 0.30, "margin": 0.25}
CONCERN_WEIGHTS = {"discount": 0.40, "high_share": 0.35, "margin": 0.25}
PATTERN_CLEAN = Band(discount_max=0.15, high_share_max=0.25, margin_min=0.40)
PATTERN_RELIANT_SHARE_MIN = 0.75
PATTERN_RELIANT_DISCOUNT_MIN = 0.35
PATTERN_PRESSURE_MARGIN_MAX = 0.30
PATTERN_PRESSURE_DISCOUNT_MIN = 0.25
PATTERNS = ("Sold cleanly", "Discount-reliant", "Margin-pressure", "Mixed")
DEEP_SHARE_MARK = 0.30
DEEP_TAIL_MEDIAN = 15.0
DEEP_TAIL_P90 = 30.0

# Dashboard.
ALL = "All"
SCOPE_DIMS = ("segment", "region", "category", "sales_channel")
REVIEW_QUEUE_ROWS = 140  # the fill of the review queue alone; Critical and High are never cut
QUEUE_TABLE_ROWS = 120
TOP_PRODUCTS = 12
TOP_DEPENDENCE = 15
QUEUE_PREVIEW_ROWS = 5
COLLAPSE_MAX_ROWS = 6
COLLAPSE_LABEL = "Other actions"
WATCH = {
    "weighted_discount_pct": Watch(0.14, 0.20),
    "margin_risk_share": Watch(0.12, 0.20),
    "high_risk_count": Watch(35, 80),
}
POSTURES = {"critical": "Intervene now", "warn": "Tight watch", "ok": "Controlled"}

# Digits at which sums of doubles are ranked, and the binary places at which they are stored:
# the order in which tasks add up then makes no new value and breaks no tie.
SUM_DIGITS = 12
SUM_BITS = 40

# Release policy.
REQUIRED_FLAGS = {
    "technically_valid": True,
    "analytically_acceptable": True,
    "decision_support_only": True,
    "publish_blocked": False,
}
REQUIRED_STATE = "decision-support only"
MAX_FAILED_CHECKS = 0
MAX_FAILED_BLOCKERS = 0
MAX_CONTRACT_FAILURES = 0
EXCLUSION_MEDIUM_SHARE = 0.05


def _fail(name: str, problem: str) -> None:
    raise ValueError(f"policy {name}: {problem}")


@dataclass(frozen=True)
class Policy:
    """The editable part of the policy; plans take it as a parameter.

    One object drives line flags, dashboard facts, leakage, scores, verdicts and checks, so a
    changed threshold moves all of them. Values are checked on creation.
    """

    discounted: float = DISCOUNTED_THRESHOLD
    high_discount: float = HIGH_DISCOUNT_THRESHOLD
    margin_at_risk: float = MARGIN_AT_RISK_MAX
    sensitivity: tuple[float, ...] = SENSITIVITY_THRESHOLDS
    healthy: Band = HEALTHY
    mixed: Band = MIXED
    breaches: Mapping[str, Breach] = field(default_factory=lambda: dict(BREACHES))
    components: Mapping[str, Blend] = field(default_factory=lambda: dict(COMPONENTS))
    priority_weights: Mapping[str, float] = field(default_factory=lambda: dict(PRIORITY_WEIGHTS))
    tiers: tuple[tuple[float, str], ...] = TIERS
    min_reliable_orders: int = MIN_RELIABLE_ORDERS
    high_revenue_share: float = HIGH_REVENUE_SHARE_THRESHOLD
    watch: Mapping[str, Watch] = field(default_factory=lambda: dict(WATCH))

    def __post_init__(self) -> None:
        shares = ("discounted", "high_discount", "margin_at_risk", "high_revenue_share")
        for name in shares:
            if not 0 < getattr(self, name) < 1:
                _fail(name, "must lie between 0 and 1")
        if self.discounted > self.high_discount:
            _fail("discounted", "must not be above high_discount")
        if not self.sensitivity or any(not 0 < t < 1 for t in self.sensitivity):
            _fail("sensitivity", "needs thresholds between 0 and 1")
        if self.mixed.discount_max < self.healthy.discount_max:
            _fail("mixed", "must be wider than healthy")
        if self.min_reliable_orders < 1:
            _fail("min_reliable_orders", "must be at least 1")
        for name, breach in self.breaches.items():
            if name not in SIGNALS or breach.span < 0:
                _fail(f"breaches.{name}", "unknown signal or negative span")
        if set(self.breaches) != set(SIGNALS):
            _fail("breaches", "needs every signal")
        if set(self.components) != set(self.priority_weights) or set(self.components) != set(COMPONENTS):
            _fail("components", "needs the three components and their weights")
        sums = {"priority_weights": sum(self.priority_weights.values())}
        for name, blend in self.components.items():
            sums[f"components.{name}"] = blend.relative_weight + blend.absolute_weight
            sums[f"components.{name}.relative"] = sum(blend.relative.values())
            sums[f"components.{name}.absolute"] = sum(blend.absolute.values())
        for name, total in sums.items():
            if abs(total - 1) > 1e-9:
                _fail(name, f"weights add up to {total}, not 1")
        lowers = [lower for lower, _ in self.tiers]
        if lowers != sorted(lowers, reverse=True) or tuple(n for _, n in self.tiers) != tuple(
            n for _, n in TIERS
        ):
            _fail("tiers", "need falling lower limits for the known labels")
        for name, watch in self.watch.items():
            if name not in WATCH or watch.warn > watch.critical:
                _fail(f"watch.{name}", "unknown indicator or warn above critical")

    @classmethod
    def from_json(cls, text: str) -> Policy:
        """A policy from JSON text; fields that are left out keep their defaults."""
        given = json.loads(text)
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            _fail(", ".join(sorted(unknown)), "unknown field")
        shapes = {"breaches": Breach, "components": Blend, "watch": Watch}
        try:
            for name, shape in shapes.items():
                if name in given:
                    given[name] = {k: shape(**v) for k, v in given[name].items()}
            for name in ("healthy", "mixed"):
                if name in given:
                    given[name] = Band(**given[name])
        except TypeError as error:
            raise ValueError(f"policy: {error}") from error
        if "tiers" in given:
            given["tiers"] = tuple((float(lower), label) for lower, label in given["tiers"])
        if "sensitivity" in given:
            given["sensitivity"] = tuple(given["sensitivity"])
        return cls(**given)

    def to_json(self) -> str:
        return json.dumps(asdict(self))


POLICY = Policy()
