"""All queries of the packet-flow engine by name, and their SQL."""

from __future__ import annotations

from flowlark.plans import edge_queries, flow_queries, wire_queries

QUERIES = flow_queries.QUERIES | wire_queries.QUERIES | edge_queries.QUERIES
ORACLES = flow_queries.ORACLES | wire_queries.ORACLES | edge_queries.ORACLES
