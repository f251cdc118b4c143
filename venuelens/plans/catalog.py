"""All registered queries."""

from __future__ import annotations

from venuelens.plans import (  # noqa: F401
    q_charts, q_filters, q_incremental, q_joins, q_large, q_rollups, q_sources, q_stats,
)
from venuelens.plans.registry import ORACLES, QUERIES  # noqa: F401
