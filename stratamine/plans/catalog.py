"""All queries, and the flagship."""

from __future__ import annotations

from stratamine.plans import clusters, explore, graphs, itemsets, round_trips, similar, sketches  # noqa: F401  they fill the registry
from stratamine.plans.registry import QUERIES, SQL

FLAGSHIP = explore.category_avg_topn

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
