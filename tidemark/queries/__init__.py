"""Registered queries of the panel engine: Spark callables with their SQL counterparts."""

from __future__ import annotations

from tidemark.queries import dynamics, evaluation, geometry, graphs, kernels, panels, reports, statistics, windows
from tidemark.queries.base import Query

QUERIES: dict[str, Query] = {}
for _module in (panels, windows, dynamics, statistics, graphs, evaluation, reports, geometry, kernels):
    QUERIES |= _module.QUERIES
