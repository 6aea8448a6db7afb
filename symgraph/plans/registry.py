"""Queries by name, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.QUERIES: dict[str, Query] = {}
        self.ORACLE: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.QUERIES[f.__name__] = f
            if sql:
                self.ORACLE[f.__name__] = sql
            return f

        return add


# The current state of the graph tables in SQL: the newest delivery of each key, without removed records.
N = """n AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) AS rn FROM nodes)
       WHERE rn = 1 AND removed_at IS NULL)"""
E = """e AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, kind
         ORDER BY ingested_at DESC NULLS LAST, confidence DESC NULLS LAST, line_number DESC NULLS LAST, metadata DESC NULLS LAST) AS rn
         FROM edges WHERE source_id <> '' AND target_id <> '') WHERE rn = 1)"""
# Edges of the analysed graph: both ends are current nodes, parallel edges are one.
G = f"{N}, {E}, g AS (SELECT DISTINCT source_id AS src, target_id AS dst FROM e WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n))"
