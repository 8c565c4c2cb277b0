"""Registered queries over the given tables."""

from threadloom.plans import annotation, cleaning, exchange, harvesting, reporting  # noqa: F401
from threadloom.plans.registry import ORACLES, QUERIES  # noqa: F401
