"""Registered queries over the driver's tables."""

from gradeloom.queries import attendance, grading, html, identity, merges, misc, overlap, plans, risk, streams  # noqa: F401
from gradeloom.queries.registry import REGISTRY, runner

__all__ = ["REGISTRY", "runner"]
