"""All registered queries."""

from tidewatch.plans import q_arrivals, q_desk, q_live, q_schedule, q_ship  # noqa: F401
from tidewatch.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
