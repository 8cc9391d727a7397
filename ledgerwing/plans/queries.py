"""Every registered query of the library's own operators, with its SQL.

The driver's star tables stand in for a catalog: parts are identifiers, orders
builds and snapshots, line items children, events the runtime's log.
"""

from __future__ import annotations

from . import catalog_queries, event_queries, function_queries, graph_queries, override_queries

_PARTS = (catalog_queries, function_queries, override_queries, graph_queries, event_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
