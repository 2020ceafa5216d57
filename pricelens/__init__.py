"""Commercial pricing analytics as Spark DataFrame plans."""

from pricelens.plans.warehouse import Warehouse
from pricelens.policy import POLICY

__all__ = ["POLICY", "Warehouse"]
