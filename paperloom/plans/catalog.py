"""Named queries over the tables, and the SQL that each must agree with."""

from __future__ import annotations

from paperloom.plans import flow_queries, geometry_queries, library_queries, link_queries, page_queries, path_queries, request_queries, text_queries

MODULES = (text_queries, link_queries, page_queries, path_queries, request_queries, library_queries, geometry_queries, flow_queries)
QUERIES: dict = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLES: dict = {k: q for m in MODULES for k, q in m.ORACLES.items()}
