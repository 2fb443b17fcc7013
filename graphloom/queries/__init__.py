"""The catalogue of registered queries and of the SQL that checks them."""

from __future__ import annotations

from . import facts, graph, intake, records, resolution, stores, text

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in (graph, text, resolution, facts, intake, records, stores):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
