"""The registered queries and their SQL, by module."""

from symgraph.plans import core_queries, extract_queries, graph_queries, match_queries, scalar_queries, serve_queries, store_queries

MODULES = [core_queries, store_queries, scalar_queries, graph_queries, match_queries, extract_queries, serve_queries]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
