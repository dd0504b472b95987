"""All queries outside the optional subpackage, by name, and SQL for them."""

from __future__ import annotations

from .queries import content, graph, metrics, notes

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (graph, metrics, content, notes):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
