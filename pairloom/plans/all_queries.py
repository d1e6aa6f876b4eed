"""Import every module that registers queries."""

from pairloom.plans import evaluation, preparation, relational, runs, screening, telemetry  # noqa: F401
from pairloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
