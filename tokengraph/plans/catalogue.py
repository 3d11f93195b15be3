"""All registered queries."""

from __future__ import annotations

from tokengraph.plans import (  # noqa: F401
    answer_queries,
    branch_queries,
    governance_queries,
    graph_queries,
    store_queries,
    table_queries,
    text_queries,
)
from tokengraph.plans.registry import ORACLES, QUERIES  # noqa: F401
