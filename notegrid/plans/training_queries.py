"""Queries of the general training-data operators: hot keys (1) and orphan references (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notegrid.operators.orphans import orphan_report, vault_orphans
from notegrid.operators.tree_agg import heavy_names, name_stats
from notegrid.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_names(table(spark, sf_dir, "knowledge_edges")).select("side", "name")


def p1_name_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_stats(table(spark, sf_dir, "knowledge_edges"))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault_orphans(*(table(spark, sf_dir, t) for t in ("notes", "knowledge_nodes", "knowledge_edges")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("ref_table", "ref_month", "record_id", "ref_target")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_name_stats": p1_name_stats, "p6_found": p6_found, "p6_report": p6_report}

_ENDS = """
ends AS (
  SELECT 'source_name' AS side, source_name AS name, target_name AS other, weight FROM knowledge_edges
  UNION ALL
  SELECT 'target_name', target_name, source_name, weight FROM knowledge_edges
)"""

_KEY = "regexp_replace(replace(lower(trim({c}, ' ' || chr(9) || chr(13) || chr(10) || chr(160) || chr(12288))), '\\', '/'), '\\.md$', '')"

_ORPHANS = f"""
refs AS (
  SELECT 'knowledge_edges' AS ref_table, id AS record_id, target_name AS ref_target, created_at AS t FROM knowledge_edges
  UNION ALL
  SELECT 'notes', ord, unnest(wiki_links), scanned_at FROM notes
), kept AS (
  SELECT *, {_KEY.format(c='ref_target')} AS k FROM refs
  WHERE length(trim(ref_target, ' ' || chr(9) || chr(13) || chr(10) || chr(160) || chr(12288))) > 0
), parents AS (
  SELECT 'knowledge_edges' AS ref_table, {_KEY.format(c='name')} AS k, created_at AS t, deleted_at FROM knowledge_nodes
  UNION ALL SELECT 'notes', {_KEY.format(c='name')}, scanned_at, deleted_at FROM notes
  UNION ALL SELECT 'notes', {_KEY.format(c='key')}, scanned_at, deleted_at FROM notes
), known AS (
  SELECT ref_table, k, min(t) AS first_t, bool_and(deleted_at IS NOT NULL) AS gone FROM parents WHERE k IS NOT NULL GROUP BY 1, 2
), orphans AS (
  SELECT DISTINCT r.ref_table, coalesce(strftime(r.t, '%Y-%m'), 'unknown') AS ref_month, r.record_id, r.ref_target,
    CASE WHEN p.k IS NULL THEN 'missing' WHEN p.gone THEN 'deleted' WHEN p.first_t > r.t THEN 'late' END AS reason
  FROM kept r LEFT JOIN known p ON p.ref_table = r.ref_table AND p.k = r.k
)"""

ORACLE = {
    "p1_found": f"""WITH {_ENDS} SELECT side, name FROM ends WHERE name <> '' GROUP BY side, name
        HAVING count(*) >= 0.02 * (SELECT count(*) FROM knowledge_edges)""",
    "p1_name_stats": f"""WITH {_ENDS} SELECT side, name, count(*) AS edges,
        CAST(sum(CAST(round(weight * 1000000) AS BIGINT)) AS BIGINT) / 1000000 AS weight_sum,
        count(DISTINCT CASE WHEN other <> '' THEN other END) AS neighbours
        FROM ends WHERE name <> '' GROUP BY side, name""",
    "p6_found": f"""WITH {_ORPHANS} SELECT ref_table, ref_month, record_id, ref_target FROM orphans WHERE reason IS NOT NULL""",
    "p6_report": f"""WITH {_ORPHANS} SELECT ref_table, ref_month, reason, count(*) AS n_refs FROM orphans
        WHERE reason IS NOT NULL GROUP BY 1, 2, 3""",
}
