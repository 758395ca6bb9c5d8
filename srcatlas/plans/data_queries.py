"""Queries of the general training-data operators: p1, p2, p6, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from srcatlas.operators import orphan_references, schema_drift, snapshot_changes
from srcatlas.plans.runtime import read

USAGE_COLUMNS = {
    "v": "bigint", "ts": "string", "session": "string", "session_source": "string", "cmd": "string", "mode": "string", "file": "string", "level": "string", "parser": "string",
    "fallback": "boolean", "savings_source": "string", "bytes_raw": "double", "bytes_out": "double", "tokens_raw_est": "bigint", "tokens_out_est": "bigint", "tokens_saved_est": "bigint",
}
MANIFEST_COLUMNS = {
    "version": "bigint", "root": "string", "indexed_config.max_file_size": "double", "indexed_config.allow_sensitive": "boolean", "indexed_config.include_hidden": "boolean",
    "built_ms": "bigint", "counts.files": "double", "counts.words": "double", "counts.trigrams": "double",
}


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return schema_drift.schema_changes(read(spark, sf, "raw_records")).select("log_file", "field", "change", "becomes")


def p1_versions(spark: SparkSession, sf: str) -> DataFrame:
    return schema_drift.schema_versions(read(spark, sf, "raw_records"))


def p1_usage(spark: SparkSession, sf: str) -> DataFrame:
    return schema_drift.consistent_table(read(spark, sf, "raw_records"), "usage", USAGE_COLUMNS)


def p1_manifests(spark: SparkSession, sf: str) -> DataFrame:
    return schema_drift.consistent_table(read(spark, sf, "raw_records"), "manifest", MANIFEST_COLUMNS)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_references.orphan_references(read(spark, sf, "imports"), read(spark, sf, "files"))


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_references.orphan_report(read(spark, sf, "imports"), read(spark, sf, "files"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_changes.snapshot_changes(read(spark, sf, "file_snapshots"))


def p6_counts(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_changes.snapshot_change_counts(read(spark, sf, "file_snapshots"))


QUERIES = {f.__name__: f for f in (p1_found, p1_versions, p1_usage, p1_manifests, p2_found, p2_report, p6_found, p6_counts)}

_CANONICAL = r"regexp_replace(regexp_replace(replace({0}, '\', '/'), '/+', '/', 'g'), '^(\./)+', '')"

_P6 = f"""
WITH steps AS (
  SELECT repo, snapshot_no, lag(snapshot_no) OVER (PARTITION BY repo ORDER BY snapshot_no) AS before_no
  FROM (SELECT DISTINCT repo, snapshot_no FROM file_snapshots WHERE repo IS NOT NULL AND snapshot_no IS NOT NULL)
), facts AS (
  SELECT repo, snapshot_no, {_CANONICAL.format("path")} AS path, lower(hash) AS hash,
         CAST(floor(CASE WHEN abs(mtime_ms) < 100000000000 THEN mtime_ms ELSE mtime_ms / 1000.0 END) AS BIGINT) AS mtime, ingested_at
  FROM file_snapshots WHERE path IS NOT NULL
), held AS (
  SELECT repo, snapshot_no, path, hash, mtime FROM facts
  QUALIFY row_number() OVER (PARTITION BY repo, snapshot_no, path ORDER BY ingested_at DESC NULLS LAST, hash DESC NULLS LAST, mtime DESC NULLS LAST) = 1
), a AS (
  SELECT h.repo, h.snapshot_no, h.path, h.hash, h.mtime FROM held h JOIN steps s USING (repo, snapshot_no) WHERE s.before_no IS NOT NULL
), b AS (
  SELECT h.repo, s.snapshot_no, h.path, h.hash, h.mtime FROM held h JOIN steps s ON s.repo = h.repo AND s.before_no = h.snapshot_no
), sides AS (
  SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.snapshot_no, b.snapshot_no) AS snapshot_no, coalesce(a.path, b.path) AS path,
         CASE WHEN b.repo IS NULL THEN 'create' WHEN a.repo IS NULL THEN 'remove' WHEN a.hash <> b.hash THEN 'modify' WHEN a.mtime <> b.mtime THEN 'touch' END AS change
  FROM a FULL OUTER JOIN b ON a.repo = b.repo AND a.snapshot_no = b.snapshot_no AND a.path = b.path
)
SELECT repo, snapshot_no, path, change FROM sides WHERE change IS NOT NULL
"""

_P2 = rf"""
WITH RECURSIVE f AS (
  SELECT file_id, repo, {_CANONICAL.format("path")} AS path, first_seen_at AS born, coalesce(deleted_at, TIMESTAMP '9999-01-01') AS gone FROM files WHERE first_seen_at IS NOT NULL
), i AS (
  SELECT DISTINCT import_id, repo, {_CANONICAL.format("path")} AS path, module, kind, {_CANONICAL.format("resolved_path")} AS resolved_path, resolved_file_id, indexed_at
  FROM imports WHERE import_id IS NOT NULL AND indexed_at IS NOT NULL
), loose AS (
  SELECT import_id, repo, indexed_at, string_split(concat_ws('/', regexp_replace(path, '(^|/)[^/]*$', ''), module), '/') AS parts
  FROM i WHERE kind IN ('es_import', 'common_js_require') AND regexp_matches(module, '^\.\.?/') AND resolved_path IS NULL AND resolved_file_id IS NULL
), walk(import_id, repo, indexed_at, parts, n, done) AS (
  SELECT import_id, repo, indexed_at, parts, 1, CAST([] AS VARCHAR[]) FROM loose
  UNION ALL
  SELECT import_id, repo, indexed_at, parts, n + 1,
    CASE WHEN parts[n] IN ('', '.') THEN done WHEN parts[n] <> '..' THEN list_append(done, parts[n])
         WHEN len(done) = 0 OR list_contains(done, '<up>') THEN list_append(done, '<up>') ELSE done[1:len(done) - 1] END
  FROM walk WHERE n <= len(parts)
), base AS (
  SELECT import_id, repo, indexed_at, CASE WHEN list_contains(done, '<up>') THEN NULL ELSE array_to_string(done, '/') END AS base FROM walk WHERE n = len(parts) + 1
), e(ext) AS (VALUES ('ts'), ('tsx'), ('js'), ('jsx'), ('mts'), ('cts'), ('mjs'), ('cjs')
), targets AS (
  SELECT import_id, repo, indexed_at, base AS path FROM base
  UNION ALL SELECT import_id, repo, indexed_at, base || '.' || ext FROM base, e WHERE NOT regexp_matches(base, '\.(ts|tsx|js|jsx|mts|cts|mjs|cjs)$')
  UNION ALL SELECT import_id, repo, indexed_at, base || '/index.' || ext FROM base, e WHERE NOT regexp_matches(base, '\.(ts|tsx|js|jsx|mts|cts|mjs|cjs)$')
), refs AS (
  SELECT import_id, 'resolved_file_id' AS ref_field, indexed_at, f.born, f.gone FROM i LEFT JOIN f ON f.file_id = i.resolved_file_id WHERE i.resolved_file_id IS NOT NULL
  UNION ALL
  SELECT import_id, 'resolved_path', indexed_at, f.born, f.gone FROM i LEFT JOIN f ON f.repo = i.repo AND f.path = i.resolved_path WHERE i.resolved_path IS NOT NULL
  UNION ALL
  SELECT import_id, 'module', indexed_at, f.born, f.gone FROM targets t LEFT JOIN f ON f.repo = t.repo AND f.path = t.path
), verdict AS (
  SELECT import_id, ref_field, indexed_at, coalesce(bool_or(born <= indexed_at AND gone > indexed_at), FALSE) AS alive,
         coalesce(bool_or(born <= indexed_at), FALSE) AS before, coalesce(bool_or(born > indexed_at), FALSE) AS later
  FROM refs GROUP BY ALL
)
SELECT DISTINCT import_id, ref_field, CASE WHEN before THEN 'deleted' WHEN later THEN 'late' ELSE 'missing' END AS reason, strftime(indexed_at, '%Y-%m') AS period
FROM verdict WHERE NOT alive
"""

SQL = {
    "p2_found": _P2,
    "p2_report": f"SELECT ref_field, period, reason, count(*) AS n FROM ({_P2}) GROUP BY ALL",
    "p6_found": _P6,
    "p6_counts": f"SELECT repo, snapshot_no, change, count(*) AS n FROM ({_P6}) GROUP BY ALL",
}
