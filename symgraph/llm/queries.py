"""Queries (and SQL, where it can express them) of the operators for training data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from symgraph.core import table
from symgraph.llm import canonical, contamination, fusion, pairs, parseability, provenance, tokens, topn


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return fusion.best_of_each_query(table(spark, d, "search_results"))


def p1_fused(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse_search_results(table(spark, d, "search_results"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return parseability.invalid_files(table(spark, d, "nodes"), table(spark, d, "files")).select("file_path")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return parseability.invalid_rates(table(spark, d, "nodes"), table(spark, d, "files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Inherited documentation only points elsewhere, so only functions' own counts here."""
    return pairs.telling_functions(table(spark, d, "nodes"))


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.documented_functions(table(spark, d, "nodes"), table(spark, d, "edges"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_nodes(table(spark, d, "nodes"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.not_by_hand(table(spark, d, "nodes")).select("file_path")


def p6_origins(spark: SparkSession, d: str) -> DataFrame:
    return provenance.file_origins(table(spark, d, "nodes"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = contamination.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def p9_cut(spark: SparkSession, d: str) -> DataFrame:
    return contamination.without_spans(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.look_alike_pairs(table(spark, d, "documents"))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    return canonical.look_alike_classes(table(spark, d, "documents"))


def p10_canonical(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonical_texts(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        p1_found, p1_fused, p3_found, p3_rates, p4_found, p4_pairs, p5_found, p6_found, p6_origins, p8_ids, p9_found, p9_cut, p10_found, p10_classes, p10_canonical,
    )
}

_FUSED = """
WITH one AS (
  SELECT query_id, node_id, max(CASE WHEN NOT isnan(score) THEN score END) AS s,
         max(CASE WHEN fts_rank > 0 THEN -fts_rank END) AS f,
         max(CASE WHEN vector_similarity <> 0 AND NOT isnan(vector_similarity) THEN vector_similarity END) AS v
  FROM search_results WHERE query_id IS NOT NULL AND node_id IS NOT NULL GROUP BY ALL),
ranked AS (
  SELECT query_id, node_id, s, f, v,
         rank() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST) AS rs,
         rank() OVER (PARTITION BY query_id ORDER BY f DESC NULLS LAST) AS rf,
         rank() OVER (PARTITION BY query_id ORDER BY v DESC NULLS LAST) AS rv
  FROM one),
fused AS (
  SELECT query_id, node_id,
         round(CASE WHEN s IS NULL THEN 0 ELSE 1.0::DOUBLE / (60 + rs) END + CASE WHEN f IS NULL THEN 0 ELSE 1.0::DOUBLE / (60 + rf) END
               + CASE WHEN v IS NULL THEN 0 ELSE 1.0::DOUBLE / (60 + rv) END, 12) AS fused,
         ((s IS NOT NULL)::INT + (f IS NOT NULL)::INT + (v IS NOT NULL)::INT)::INT AS n_found
  FROM ranked)
"""

ORACLE: dict[str, str] = {
    "p1_found": _FUSED + """SELECT query_id, node_id FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, node_id) AS rn FROM fused) WHERE rn <= 3""",
    "p1_fused": _FUSED + "SELECT query_id, node_id, fused, n_found FROM fused",
    "p5_found": """
        SELECT community_id, kind, id FROM (
          SELECT community_id, kind, id, row_number() OVER (PARTITION BY community_id, kind ORDER BY pr DESC, id) AS rn
          FROM (SELECT community_id, kind, id, max(pagerank) AS pr FROM nodes
                WHERE community_id IS NOT NULL AND kind IS NOT NULL AND id IS NOT NULL AND pagerank IS NOT NULL AND NOT isnan(pagerank)
                GROUP BY ALL)) WHERE rn <= 3""",
}
