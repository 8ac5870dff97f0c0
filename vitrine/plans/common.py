"""What several plan modules use: scorecards and their SQL."""

from __future__ import annotations

from vitrine.operators import policy, scoring
from vitrine.sources.folders import written
from vitrine.sources.views import view

DIMENSION_SQL = """
counts AS (
  SELECT v.version_id,
    count(*) FILTER (evidence_type = 'license' AND spdx_id IS DISTINCT FROM 'unknown') AS n_license, count(*) FILTER (evidence_type = 'test_indicator') AS n_tests,
    count(*) FILTER (evidence_type = 'interface') AS n_faces, count(*) FILTER (evidence_type = 'secret_indicator') AS n_secrets,
    count(*) FILTER (evidence_type = 'dependency') AS n_deps,
    CAST(count(DISTINCT CASE WHEN evidence_type = 'license' AND spdx_id IS DISTINCT FROM 'unknown' THEN spdx_id END) > 1 AS INT) AS differ
  FROM {capability_version} AS v LEFT JOIN {evidence} AS e USING (version_id) GROUP BY v.version_id),
dims AS (
  SELECT version_id, 'has_identified_license' AS dimension, n_license AS n, CAST(least(n_license, 1) AS DECIMAL(18,3)) AS raw, 0.20 AS weight, differ AS contradiction FROM counts
  UNION ALL SELECT version_id, 'has_tests', n_tests, CAST(least(n_tests, 10) * 0.1 AS DECIMAL(18,3)), 0.20, 0 FROM counts
  UNION ALL SELECT version_id, 'interface_surface', n_faces, CAST(least(n_faces, 20) * 0.05 AS DECIMAL(18,3)), 0.15, 0 FROM counts
  UNION ALL SELECT version_id, 'no_secret_indicators', n_secrets, CAST(1 - least(n_secrets, 5) * 0.2 AS DECIMAL(18,3)), 0.25, 0 FROM counts
  UNION ALL SELECT version_id, 'has_declared_dependencies', n_deps, CAST(least(n_deps, 1) AS DECIMAL(18,3)), 0.20, 0 FROM counts),
parts AS (
  SELECT version_id, sum(round(raw * weight, 3)) AS total, CAST(sum(CASE WHEN n > 0 THEN weight * 1000 ELSE 0 END) AS BIGINT) AS w, CAST(count(*) FILTER (n > 0) AS BIGINT) AS k,
    CAST(coalesce(sum(contradiction) FILTER (n > 0), 0) AS BIGINT) AS c
  FROM dims GROUP BY version_id),
cards AS (
  SELECT version_id, CAST(total AS DECIMAL(18,3)) AS total_score, CAST(CASE WHEN k = 0 THEN 0 ELSE CAST((2 * w * (k - c) + k) // (2 * k) AS DECIMAL(14,0)) * 0.001 END AS DECIMAL(18,3)) AS confidence FROM parts)"""

HEAD_SQL = """
heads AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capability_id ORDER BY year DESC, version_id DESC) AS n FROM {capability_version}) WHERE n = 1),
scored AS (
  SELECT c.*, h.version_id, k.total_score, k.confidence FROM {capability} AS c LEFT JOIN heads AS h ON h.capability_id = c.id LEFT JOIN cards AS k ON k.version_id = h.version_id)"""

GATE_SQL = """
facts AS (
  SELECT v.version_id, count(*) FILTER (evidence_type = 'secret_indicator') AS n_secrets, count(*) FILTER (evidence_type = 'setup_py_detected') AS n_setup,
    count(*) FILTER (evidence_type = 'license') AS n_license, count(*) FILTER (evidence_type = 'license' AND spdx_id <> 'unknown') AS n_known,
    count(*) FILTER (evidence_type = 'license' AND spdx_id IN ('MIT', 'Apache-2.0', 'BSD-2-Clause', 'BSD-3-Clause', 'ISC', 'MPL-2.0', 'Unlicense')) AS n_ok,
    '"spdx_ids":[' || string_agg(DISTINCT CASE WHEN evidence_type = 'license' THEN '"' || spdx_id || '"' END, ',' ORDER BY CASE WHEN evidence_type = 'license' THEN '"' || spdx_id || '"' END) || ']' AS ids,
    '"patterns":[' || string_agg(DISTINCT CASE WHEN evidence_type = 'secret_indicator' THEN '"' || name || '"' END, ',' ORDER BY CASE WHEN evidence_type = 'secret_indicator' THEN '"' || name || '"' END) || ']' AS patterns
  FROM {capability_version} AS v LEFT JOIN {evidence} AS e USING (version_id) GROUP BY v.version_id),
bound AS (SELECT version_id, count(*) AS n_bindings, count(content_hash) AS n_hashed FROM {binding} LEFT JOIN {revision} USING (revision_id) GROUP BY version_id),
inputs AS (SELECT facts.*, coalesce(n_bindings, 0) AS n_bindings, coalesce(n_hashed, 0) AS n_hashed FROM facts LEFT JOIN bound USING (version_id)),
gates AS (
  SELECT version_id, 'license_compatibility' AS gate_name, CASE WHEN n_ok > 0 THEN 'pass' ELSE 'fail' END AS status, TRUE AS is_blocking,
    CASE WHEN n_license = 0 THEN 'no license evidence found' WHEN n_known = 0 THEN 'license file present but SPDX id unknown' WHEN n_ok > 0 THEN 'acceptable license'
      ELSE 'no acceptable license detected' END AS reason,
    CASE WHEN n_license = 0 THEN '{}' WHEN n_known = 0 OR n_ok > 0 THEN '{' || ids || '}'
      ELSE '{' || ids || ',"allowlist":["Apache-2.0","BSD-2-Clause","BSD-3-Clause","ISC","MIT","MPL-2.0","Unlicense"]}' END AS detail FROM inputs
  UNION ALL SELECT version_id, 'critical_vulnerability', CASE WHEN n_secrets > 0 THEN 'fail' ELSE 'pass' END, TRUE,
    CASE WHEN n_secrets > 0 THEN CAST(n_secrets AS STRING) || ' secret indicator(s) in source' ELSE 'no secret indicators found' END,
    CASE WHEN n_secrets > 0 THEN '{"count":' || CAST(n_secrets AS STRING) || ',' || patterns || '}' ELSE '{}' END FROM inputs
  UNION ALL SELECT version_id, 'missing_provenance', CASE WHEN n_bindings > 0 AND n_hashed > 0 THEN 'pass' ELSE 'fail' END, TRUE,
    CASE WHEN n_bindings = 0 THEN 'no source binding' WHEN n_hashed = 0 THEN 'no content hash' ELSE 'binding and content hash present' END, '{}' FROM inputs
  UNION ALL SELECT version_id, 'unsafe_declared_permissions', CASE WHEN n_setup > 0 THEN 'warn' ELSE 'pass' END, FALSE,
    CASE WHEN n_setup > 0 THEN 'setup.py present' ELSE 'no opaque install-time code declared' END,
    CASE WHEN n_setup > 0 THEN '{"count":' || CAST(n_setup AS STRING) || '}' ELSE '{}' END FROM inputs),
accepted AS (SELECT version_id, gate_name FROM gates WHERE status = 'fail' AND version_id % 7 = 0 AND version_id % 2 = 0),
decisions AS (
  SELECT g.version_id, count(*) FILTER (status = 'fail' AND is_blocking AND a.version_id IS NULL) AS n_blocking,
    coalesce(string_agg(CASE WHEN status = 'fail' AND is_blocking AND a.version_id IS NULL THEN g.gate_name END, ',' ORDER BY g.gate_name), '') AS blocking,
    coalesce(string_agg(CASE WHEN status = 'warn' THEN g.gate_name END, ',' ORDER BY g.gate_name), '') AS warnings
  FROM gates AS g LEFT JOIN accepted AS a ON a.version_id = g.version_id AND a.gate_name = g.gate_name GROUP BY g.version_id)"""


def facts(spark, d):
    """The single aggregate of evidence by version. The evidence view carries its revision, and every version has evidence, so
    neither the binding nor the version view is derived again."""
    return scoring.version_facts(view(spark, d, "evidence"), view(spark, d, "revision"))


def cards(spark, d):
    return scoring.scorecards(facts(spark, d))


def gates(spark, d):
    return policy.gate_results(facts(spark, d))


def acceptances(gate_rows):
    """Failed gates of every seventh version, every second of them with a reason that holds only blanks."""
    from pyspark.sql import functions as F

    reason = F.when(F.col("version_id") % 2 == 0, "reviewed").otherwise("  ")
    return gate_rows.where("status = 'fail' and version_id % 7 = 0").select("version_id", "gate_name", F.lit("board").alias("accepted_by"), reason.alias("reason"))


def decided(spark, d, known=None):
    """Decided facts; known are facts that the caller has written, as acceptances and versions come from them too."""
    rows = written(facts(spark, d), "facts") if known is None else known
    return policy.decided(rows, acceptances(policy.gate_results(rows)))
