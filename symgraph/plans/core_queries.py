"""Queries of the core operators for keeping tables up to date and sound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.core import table
from symgraph.operators import incremental, integrity


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.files_to_parse(*(table(spark, d, t) for t in ("file_scans", "files", "parse_runs")))


def p2_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The ledger itself: the processed scan numbers as disjoint intervals."""
    return incremental.derive_ledger(*(table(spark, d, t) for t in ("file_scans", "files", "parse_runs"))).select("lo", "hi")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = integrity.dangling(*(table(spark, d, t) for t in ("edges", "nodes", "external_symbols")))
    return found.select("source_id", "target_id", "kind", "ref_field").distinct()


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return integrity.dangling_report(*(table(spark, d, t) for t in ("edges", "nodes", "external_symbols")))


def p7_never(spark: SparkSession, d: str) -> DataFrame:
    """(source_id, target_id): edges of which a pair of ids (null allowed, partial match) was never linked by a containment."""
    e = table(spark, d, "edges")
    held = e.filter("kind = 'contains'").select(F.col("source_id").alias("ps"), F.col("target_id").alias("pt"))
    refs = e.filter("kind = 'calls'").select("source_id", F.when(F.col("target_id") != "", F.col("target_id")).alias("target_id"))
    return integrity.orphans(refs, held, {"source_id": "ps", "target_id": "pt"}, "partial").distinct()


QUERIES = {f.__name__: f for f in (p2_found, p2_intervals, p7_found, p7_report, p7_never)}

_STATE = r"""
WITH stored AS (
  SELECT file_path,
         max_by({'h': nullif(regexp_replace(regexp_replace(lower(trim(content_hash)), '^[a-z0-9-]+[:=]\s*', ''), '\s+', '', 'g'), '')},
                {'t': coalesce(last_parsed, TIMESTAMP '1900-01-01'), 'r': run_id}).h AS stored
  FROM files WHERE run_id IN (SELECT run_id FROM parse_runs WHERE status = 'success') GROUP BY file_path),
s AS (
  SELECT file_path, scan_id, op, {'t': coalesce(seen_at, TIMESTAMP '1900-01-01'), 's': scan_id} AS o,
         nullif(regexp_replace(regexp_replace(lower(trim(content_hash)), '^[a-z0-9-]+[:=]\s*', ''), '\s+', '', 'g'), '') AS h
  FROM file_scans WHERE file_path IS NOT NULL AND scan_id IS NOT NULL),
state AS (
  SELECT file_path, max_by(op, o) AS last_op, max_by(h, o) FILTER (h IS NOT NULL) AS digest
  FROM s GROUP BY file_path),
due AS (
  SELECT state.* FROM state LEFT JOIN stored USING (file_path)
  WHERE digest IS NOT NULL AND last_op <> 'deleted' AND (stored.stored IS NULL OR stored.stored <> digest)),
done AS (
  SELECT DISTINCT s.scan_id FROM s JOIN (SELECT file_path, max(o) AS o FROM s JOIN stored USING (file_path) WHERE h = stored GROUP BY 1) m ON m.file_path = s.file_path AND s.o <= m.o)
"""
_PRESENT = """
WITH present AS (
  SELECT id, CASE WHEN max(a) = 0 THEN min(b) END AS born, CASE WHEN max(a) = 0 THEN min(g) END AS gone FROM (
    SELECT id, ingested_at AS b, removed_at AS g, 0 AS a FROM nodes UNION ALL SELECT id, NULL, NULL, 1 FROM external_symbols)
  WHERE id <> '' GROUP BY id),
refs AS (
  SELECT source_id, target_id, kind, 'source_id' AS ref_field, source_id AS ref, ingested_at FROM edges
  UNION ALL SELECT source_id, target_id, kind, 'target_id', target_id, ingested_at FROM edges),
bad AS (
  SELECT refs.* FROM refs LEFT JOIN present ON ref = id
  WHERE ref <> '' AND (id IS NULL OR ingested_at < born OR ingested_at >= gone))
"""

ORACLE = {
    "p2_found": _STATE + "SELECT file_path FROM due",
    "p2_intervals": _STATE + """SELECT min(scan_id) AS lo, max(scan_id) AS hi FROM (
          SELECT scan_id, scan_id // 65536 AS bucket, scan_id - row_number() OVER (PARTITION BY scan_id // 65536 ORDER BY scan_id) AS run FROM done)
        GROUP BY bucket, run""",
    "p7_found": _PRESENT + "SELECT DISTINCT source_id, target_id, kind, ref_field FROM bad",
    "p7_report": _PRESENT + "SELECT ref_field, strftime(ingested_at, '%Y-%m') AS month, count(*) AS orphan_refs, count(DISTINCT ref) AS orphan_ids FROM bad GROUP BY ALL",
    "p7_never": """
        WITH held AS (SELECT DISTINCT source_id AS s, target_id AS t FROM edges WHERE kind = 'contains'),
        refs AS (SELECT DISTINCT source_id, nullif(target_id, '') AS target_id FROM edges WHERE kind = 'calls')
        SELECT source_id, target_id FROM refs
        WHERE (source_id IS NOT NULL OR target_id IS NOT NULL)
          AND NOT EXISTS (SELECT 1 FROM held WHERE (refs.source_id IS NULL OR held.s = refs.source_id) AND (refs.target_id IS NULL OR held.t = refs.target_id))""",
}
