"""Problem 3: orphan references of the record tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.operators.references import ForeignKey, OrphanCascade, orphan_report
from folioscope.runtime import table

KEYS = [
    ForeignKey("sections", "section_id", "member_object_ids", "layout_objects", "object_id"),
    ForeignKey("layout_objects", "object_id", "section_id", "sections", "section_id"),
    ForeignKey("papers", "paper_id", "chunk_ids", "chunks", "chunk_id"),
]
TABLES = ("sections", "layout_objects", "papers", "chunks")


def _inputs(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame]:
    return {t: table(spark, d, t) for t in TABLES}, table(spark, d, "removals")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The direct orphans of the cascade."""
    tables, removals = _inputs(spark, d)
    return OrphanCascade(tables, KEYS, removals).orphans().where("orphan = 'direct'").select("ref_table", "record_id", "target_id", "state")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    tables, removals = _inputs(spark, d)
    return orphan_report(OrphanCascade(tables, KEYS, removals).orphans())


def p3_cascade(spark: SparkSession, d: str) -> DataFrame:
    tables, removals = _inputs(spark, d)
    return OrphanCascade(tables, KEYS, removals).records()


QUERIES = {f.__name__: f for f in (p3_found, p3_report, p3_cascade)}

_FOUND = r"""
WITH edges AS (
  SELECT 'sections' AS ref_table, 'layout_objects' AS target_table, section_id AS record_id, ingested_at, unnest(member_object_ids) AS raw FROM sections
  UNION ALL SELECT 'layout_objects', 'sections', object_id, ingested_at, section_id FROM layout_objects
  UNION ALL SELECT 'papers', 'chunks', paper_id, ingested_at, unnest(chunk_ids) FROM papers
), firsts AS (
  SELECT 'sections' AS ref_table, section_id AS record_id, min(ingested_at) AS ref_first FROM sections GROUP BY ALL
  UNION ALL SELECT 'layout_objects', object_id, min(ingested_at) FROM layout_objects GROUP BY ALL
  UNION ALL SELECT 'papers', paper_id, min(ingested_at) FROM papers GROUP BY ALL
), refs AS (
  SELECT DISTINCT ref_table, target_table, record_id, lower(regexp_replace(raw, '^\s+|\s+$', '', 'g')) AS target_id FROM edges
  WHERE raw IS NOT NULL AND regexp_replace(raw, '^\s+|\s+$', '', 'g') <> ''
), known AS (
  SELECT 'layout_objects' AS target_table, lower(object_id) AS target_id, min(ingested_at) AS first_in, max(ingested_at) AS last_in FROM layout_objects GROUP BY ALL
  UNION ALL SELECT 'sections', lower(section_id), min(ingested_at), max(ingested_at) FROM sections GROUP BY ALL
  UNION ALL SELECT 'chunks', lower(chunk_id), min(ingested_at), max(ingested_at) FROM chunks GROUP BY ALL
), gone AS (
  SELECT record_table AS target_table, lower(record_id) AS target_id, max(removed_at) AS last_removed, 1 AS logged FROM removals GROUP BY ALL
), judged AS (
  SELECT r.ref_table, r.record_id, r.target_table, r.target_id, f.ref_first,
    CASE WHEN g.logged = 1 AND (k.target_id IS NULL OR g.last_removed >= k.last_in) THEN 'deleted'
         WHEN k.target_id IS NULL THEN 'missing'
         WHEN k.first_in > f.ref_first + INTERVAL 24 HOUR THEN 'late' END AS state
  FROM refs r JOIN firsts f USING (ref_table, record_id)
  LEFT JOIN known k USING (target_table, target_id) LEFT JOIN gone g USING (target_table, target_id)
)
"""

_SPREAD = _FOUND.replace("WITH edges", "WITH RECURSIVE edges") + """, spread AS (
  SELECT DISTINCT ref_table, record_id, 0 AS depth FROM judged WHERE state IN ('deleted', 'missing')
  UNION
  SELECT r.ref_table, r.record_id, s.depth + 1 FROM refs r JOIN spread s ON r.target_table = s.ref_table AND r.target_id = lower(s.record_id) WHERE s.depth < 12
)
"""

ORACLE = {
    "p3_found": _FOUND + "SELECT ref_table, record_id, target_id, state FROM judged WHERE state IS NOT NULL",
    "p3_report": _SPREAD
    + """, orphans AS (
  SELECT ref_table, record_id, ref_first, 'direct' AS orphan, state FROM judged WHERE state IS NOT NULL
  UNION ALL
  SELECT j.ref_table, j.record_id, j.ref_first, 'inherited', NULL FROM judged j
  WHERE j.state IS NULL AND EXISTS (SELECT 1 FROM spread s WHERE s.ref_table = j.target_table AND lower(s.record_id) = j.target_id)
)
SELECT ref_table, strftime(ref_first, '%Y-%m') AS period, orphan, state, count(*) AS n_references, count(DISTINCT record_id) AS n_records FROM orphans GROUP BY ALL""",
    "p3_cascade": _SPREAD
    + "SELECT ref_table, record_id, CASE WHEN min(depth) = 0 THEN 'direct' ELSE 'inherited' END AS orphan, CAST(min(depth) AS INTEGER) AS depth FROM spread GROUP BY ALL",
}
