"""All registered queries and their oracle SQL."""

from __future__ import annotations

from secscan.plans import dependency_queries, fix_queries, more_queries, scan_queries, service_queries

QUERIES: dict = {}
ORACLES: dict = {}

for _m in (scan_queries, dependency_queries, more_queries, fix_queries, service_queries):
    QUERIES.update(_m.QUERIES)
    ORACLES.update(_m.ORACLES)
