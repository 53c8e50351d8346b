"""Queries of the general data-processing problems and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codequarry.operators import changes, orphans


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return changes.replay(table(spark, folder, "runs"), table(spark, folder, "scans"))[1]


def p1_record(spark: SparkSession, folder: str) -> DataFrame:
    """The record after the last run: what the next run is compared with."""
    tracker, _ = changes.replay(table(spark, folder, "runs"), table(spark, folder, "scans"))
    return tracker.state().selectExpr("scope AS repo", "key AS path", "hash")


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.index_orphans(*(table(spark, folder, t) for t in ("files", "chunks", "refs", "purges")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("rel", "row_id").distinct()


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, folder))


def p2_parents(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.parent_orphans(table(spark, folder, "chunks"))


_P1 = """
WITH ok AS (
  SELECT run_id, repo, clean, step, sum(clean) OVER (PARTITION BY repo ORDER BY step) AS clean_so_far
  FROM (SELECT run_id, repo, CASE WHEN coalesce(walk_had_errors, false) THEN 0 ELSE 1 END AS clean,
               row_number() OVER (PARTITION BY repo ORDER BY started_at, run_id) AS step
        FROM (SELECT DISTINCT * FROM runs) WHERE status = 'ok')),
seen AS (
  SELECT o.repo, o.step, o.run_id, s.path, o.clean, o.clean_so_far,
         arg_max(s.hash, (s.scanned_at, s.scan_id)) FILTER (WHERE s.hash IS NOT NULL) AS hash
  FROM scans s JOIN ok o USING (run_id) WHERE s.path IS NOT NULL GROUP BY ALL),
missed AS (
  SELECT *, clean_so_far - sum(clean) OVER (PARTITION BY repo, path ORDER BY step) AS missed FROM seen),
hashed AS (
  SELECT *, lag(hash) OVER w AS before, lag(missed) OVER w AS missed_before
  FROM missed WHERE hash IS NOT NULL WINDOW w AS (PARTITION BY repo, path ORDER BY step))
"""

_P2 = """
WITH last AS (SELECT rel, row_id, max(purged_at) AS purged_at FROM purges GROUP BY ALL),
live_files AS (SELECT DISTINCT file_id FROM files f WHERE NOT EXISTS
  (SELECT 1 FROM last l WHERE l.rel = 'files' AND l.row_id = f.file_id AND l.purged_at >= f.indexed_at)),
live_chunks AS (SELECT DISTINCT chunk_id FROM chunks c WHERE NOT EXISTS
  (SELECT 1 FROM last l WHERE l.rel = 'chunks' AND l.row_id = c.chunk_id AND l.purged_at >= c.indexed_at)),
found AS (
  SELECT DISTINCT 'chunks' AS rel, chunk_id AS row_id, CAST(indexed_at AS DATE) AS day FROM chunks
  WHERE file_id IS NOT NULL AND file_id NOT IN (SELECT file_id FROM live_files)
  UNION ALL
  SELECT DISTINCT 'refs', ref_id, CAST(indexed_at AS DATE) FROM refs
  WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM live_chunks))
"""

QUERIES = {"p1_found": p1_found, "p1_record": p1_record, "p2_found": p2_found, "p2_report": p2_report, "p2_parents": p2_parents}

ORACLE = {
    "p1_found": _P1 + "SELECT run_id, path FROM hashed WHERE before IS NULL OR missed <> missed_before OR hash <> before",
    "p1_record": _P1
    + """, total AS (SELECT repo, max(clean_so_far) AS all_clean FROM ok GROUP BY repo),
    final AS (SELECT repo, path, max(clean_so_far) AS at_last, arg_max(missed, step) AS missed_last FROM missed GROUP BY repo, path),
    held AS (SELECT repo, path, arg_max(hash, step) AS hash, arg_max(missed, step) AS missed FROM hashed GROUP BY repo, path)
    SELECT h.repo, h.path, h.hash FROM held h JOIN final f USING (repo, path) JOIN total t USING (repo)
    WHERE h.missed = f.missed_last AND t.all_clean = f.at_last""",
    "p2_parents": """SELECT DISTINCT chunk_id, CASE WHEN file_id IS NULL THEN 'parent' WHEN parent IS NULL THEN 'file' ELSE 'file, parent' END AS named FROM chunks c
    WHERE (file_id IS NOT NULL AND parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chunks p WHERE p.file_id = c.file_id AND p.ident = c.parent))
       OR (file_id IS NULL AND parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chunks p WHERE p.ident = c.parent))""",
    "p2_found": _P2 + "SELECT DISTINCT rel, row_id FROM found",
    "p2_report": _P2 + "SELECT rel, day, count(*) AS orphans FROM found GROUP BY ALL",
}
