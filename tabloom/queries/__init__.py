"""Registered queries over the driver tables, each with its check in SQL where SQL can express it."""

from .registry import REGISTRY
from . import aggregates, cleaning, discovery, incidents, joins, plans, rows, scalars, sources  # noqa: F401  (registration)

__all__ = ["REGISTRY"]
