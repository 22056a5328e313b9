"""Registered queries over the driver's tables."""

from reviewlens.plans import pages, queries  # noqa: F401  they register themselves
from reviewlens.plans.registry import QUERIES, SQL  # noqa: F401
