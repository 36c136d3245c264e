"""All queries of the engine's own operators and their SQL."""

from __future__ import annotations

from siftline.plans import case_plans, crawl_plans, io_plans, relational_plans, search_plans, text_plans
from siftline.plans.base import Query

_MODULES = (text_plans, search_plans, crawl_plans, relational_plans, case_plans, io_plans)


def queries() -> dict[str, Query]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
