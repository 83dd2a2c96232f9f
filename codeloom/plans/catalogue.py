"""Everything registered, in one place."""

from __future__ import annotations

from . import graph_queries, shop_queries, text_queries  # noqa: F401  (they register)
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
