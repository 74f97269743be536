"""All registered queries."""

from __future__ import annotations

from . import analysis_queries, report_queries, tables_queries
from .common import Query


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for registry in (tables_queries.Q, analysis_queries.Q, report_queries.Q):
        clash = out.keys() & registry.keys()
        if clash:
            raise ValueError(f"queries registered twice: {sorted(clash)}")
        out.update(registry)
    return out
