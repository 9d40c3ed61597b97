"""The comparison queries, one per operator."""

from backtrail.plans import frames, heads, histories, labels, parsing, scores, vectors  # noqa: F401
from backtrail.plans.base import REGISTRY

__all__ = ["REGISTRY"]
