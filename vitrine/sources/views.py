"""Registry views as projections of the driver's tables, in SQL that Spark and DuckDB read alike.

Integer arithmetic only, so that both give the same rows. {name} stands for a table or for another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")

VIEWS = {
    "capability": """
SELECT p_partkey AS id, p_name AS display_name, replace(p_name, ' ', '-') AS tail,
  CASE WHEN p_type = 'ECONOMY' THEN CASE WHEN p_size % 2 = 0 THEN 'pypi' ELSE 'npm' END ELSE 'source' END AS ecosystem,
  CASE WHEN p_type = 'ECONOMY' THEN (CASE WHEN p_size % 2 = 0 THEN 'pypi:' ELSE 'npm:' END) || replace(p_name, ' ', '-')
    ELSE 'source:github:' || lower(replace(p_brand, '#', '-')) || '/' || replace(p_name, ' ', '-') END AS normalized_key,
  'capability' AS kind,
  CASE p_type WHEN 'ECONOMY' THEN 'library' WHEN 'STANDARD' THEN 'repo' WHEN 'PROMO' THEN 'mcp_tool' WHEN 'SMALL' THEN 'skill'
    WHEN 'MEDIUM' THEN 'agent' ELSE 'workflow_template' END AS component_kind,
  CASE p_size % 10 WHEN 0 THEN 'python_import' WHEN 1 THEN 'npm_import' WHEN 2 THEN 'mcp_stdio' WHEN 3 THEN 'mcp_http' WHEN 4 THEN 'claude_skill'
    WHEN 5 THEN 'claude_agent' WHEN 6 THEN 'cli_subprocess' WHEN 7 THEN 'git_clone' WHEN 8 THEN 'http_endpoint' ELSE NULL END AS runtime,
  CASE p_partkey % 5 WHEN 0 THEN 'free' WHEN 1 THEN 'cheap_paid' WHEN 2 THEN 'paid' WHEN 3 THEN 'unknown' ELSE NULL END AS cost_tier,
  CASE p_partkey % 8 WHEN 0 THEN 'MIT' WHEN 1 THEN 'Apache-2.0' WHEN 2 THEN 'GPL-3.0' WHEN 3 THEN 'BSD-3-Clause' WHEN 4 THEN 'MPL-2.0'
    WHEN 5 THEN 'ISC' WHEN 6 THEN 'AGPL-3.0' ELSE NULL END AS license_spdx,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST((p_partkey * 37) % 12000 AS INT) END AS stars,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_partkey % 5 AS INT) END AS forks,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_partkey % 3 AS INT) END AS open_issues,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST((p_partkey * 13) % 900 AS INT) END AS days_old,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_name END AS description,
  CASE WHEN p_partkey % 6 = 0 THEN p_name ELSE NULL END AS gemini_description,
  CASE p_partkey % 5 WHEN 0 THEN 'stdio' WHEN 1 THEN 'sse' WHEN 2 THEN 'http' WHEN 3 THEN 'unknown' ELSE NULL END AS transport,
  CASE p_partkey % 6 WHEN 0 THEN 'cuda,ml' WHEN 1 THEN 'kafka' WHEN 2 THEN 'Cron,web' WHEN 3 THEN 'web' WHEN 4 THEN 'scheduler' ELSE NULL END AS topics,
  CASE WHEN p_partkey % 3 = 1 THEN 'h' || CAST(p_size AS STRING) WHEN p_partkey % 12 = 5 THEN '' ELSE NULL END AS content_hash,
  CASE WHEN p_size % 4 = 0 THEN 'Python' ELSE NULL END AS language,
  CASE WHEN p_partkey % 5 < 2 THEN 'https://example.com/' || CAST(p_partkey AS STRING) ELSE NULL END AS html_url,
  CASE WHEN p_partkey % 16 = 4 THEN 'seed' ELSE NULL END AS seed_note,
  p_partkey % 10 = 3 AS requires_gpu,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_partkey % 40 AS INT) END AS monthly_cost_usd
FROM {part}""",
    "capability_version": """
SELECT DISTINCT l_partkey * 10000 + extract(YEAR FROM o_orderdate) AS version_id, l_partkey AS capability_id, CAST(extract(YEAR FROM o_orderdate) AS INT) AS year
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "evidence": """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS evidence_id,
  l_partkey * 10000 + extract(YEAR FROM o_orderdate) AS version_id,
  CASE l_returnflag || l_linestatus WHEN 'RO' THEN 'dependency' WHEN 'RF' THEN 'interface' WHEN 'AF' THEN 'test_indicator' WHEN 'AO' THEN 'license'
    WHEN 'NO' THEN 'secret_indicator' ELSE 'setup_py_detected' END AS evidence_type,
  CASE CAST(round(l_tax * 100) AS INT) WHEN 0 THEN 'unknown' WHEN 1 THEN 'MIT' WHEN 2 THEN 'Apache-2.0' WHEN 3 THEN 'GPL-3.0' WHEN 4 THEN 'BSD-3-Clause'
    WHEN 5 THEN 'ISC' WHEN 6 THEN 'AGPL-3.0' WHEN 7 THEN 'MPL-2.0' ELSE 'Unlicense' END AS spdx_id,
  'name' || CAST(CAST(round(l_discount * 100) AS INT) AS STRING) AS name,
  CASE WHEN l_linenumber % 2 = 0 THEN 'pypi' ELSE 'npm' END AS ecosystem,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 'def f' || CAST(l_linenumber AS STRING) || '(x)' END AS signature,
  l_suppkey AS revision_id
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "revision": """
SELECT s_suppkey AS revision_id, n_regionkey AS asset_id, s_suppkey AS identified_at, 'rev' || CAST(s_suppkey AS STRING) AS revision_key,
  CASE WHEN s_suppkey % 10 = 0 THEN 'unavailable' ELSE 'snapshotted' END AS snapshot_status,
  CASE WHEN s_suppkey % 17 = 0 THEN NULL ELSE 'h' || CAST(s_suppkey % 40 AS STRING) END AS content_hash
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "binding": """
SELECT DISTINCT version_id, revision_id FROM {evidence}""",
    "file": """
SELECT source || '/' || lang AS revision, lang || '/' || CAST(doc_id AS STRING) || '.md' AS path, text AS content, sha256(text) AS content_hash FROM {documents}""",
    "attempt": """
SELECT event_id, user_id AS run, event_type AS step, ts, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
  CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 3 WHEN 0 THEN 'transient' WHEN 1 THEN 'input' ELSE 'policy' END AS error_class,
  CAST(user_id AS STRING) || '/' || event_type || '/' || CAST(CAST(ts AS DATE) AS STRING) AS command_id
FROM {events}""",
    "transition": """
SELECT event_id, run, ts, status, CASE WHEN n = 1 AND k % 5 <> 0 THEN NULL WHEN k % 10 = 0 THEN 'lost' ELSE before END AS from_state,
  CASE WHEN status = 'failed' THEN before ELSE step END AS to_state, CASE WHEN status = 'failed' THEN 'guard_failed:tests,license' ELSE 'step done' END AS reason
FROM (
  SELECT *, substr(max(CASE WHEN status = 'succeeded' THEN lpad(CAST(n AS STRING), 12, '0') || step END) OVER (PARTITION BY run ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 13) AS before
  FROM (SELECT event_id, run, ts, step, status, k, row_number() OVER (PARTITION BY run ORDER BY ts, event_id) AS n FROM {attempt}))""",
    "response": """
SELECT doc_id AS request_id, source AS provider,
  CASE WHEN quality = 1 AND doc_id % 5 = 0 THEN '{"component_kind": "repo", "confidence": ' || CAST(doc_id % 3 AS STRING) || '}'
    WHEN quality = 1 AND doc_id % 5 = 1 THEN '{"component_kind": "robot", "confidence": 0.9}'
    WHEN quality = 1 AND doc_id % 5 = 2 THEN '{"confidence": 0.9}'
    WHEN quality = 1 AND doc_id % 5 = 3 THEN '{"component_kind": "library", "confidence": "0.9"}'
    WHEN quality = 1 THEN '{"component_kind": "library", "confidence": 0.85}'
    ELSE 'no json' END AS raw_response,
  n_chars AS latency_ms
FROM {labels} JOIN {documents} USING (doc_id)""",
    "requirement": """
SELECT n_nationkey AS req_id, n_name AS slug FROM {nation}""",
    "scorecard": """
SELECT DISTINCT version_id FROM {evidence} WHERE evidence_type <> 'setup_py_detected'""",
    "requirement_constraint": """
SELECT n_nationkey AS req_id, 'required_interface' AS kind, 'NAME' || CAST(n_nationkey % 11 AS STRING) AS name,
  CASE WHEN n_nationkey % 2 = 0 THEN 'f1' ELSE NULL END AS fragment, CAST(NULL AS STRING) AS ecosystem, CAST(NULL AS STRING) AS spdx_ids FROM {nation} WHERE n_nationkey % 7 <> 3
UNION ALL SELECT n_nationkey, 'license_allowlist', NULL, NULL, NULL, CASE WHEN n_nationkey % 6 = 5 THEN '' ELSE 'mit,apache-2.0' END FROM {nation} WHERE n_nationkey % 3 <> 0 AND n_nationkey % 7 <> 3
UNION ALL SELECT n_nationkey, 'forbidden_dependency', 'name' || CAST(n_nationkey % 7 AS STRING), NULL, CASE WHEN n_nationkey % 5 = 4 THEN '' ELSE 'PyPI' END, NULL FROM {nation}
  WHERE n_nationkey % 4 <> 1 AND n_nationkey % 7 <> 3
UNION ALL SELECT n_nationkey, 'colour', NULL, NULL, NULL, NULL FROM {nation} WHERE n_nationkey % 9 = 0
UNION ALL SELECT n_nationkey, 'shape', NULL, NULL, NULL, NULL FROM {nation} WHERE n_nationkey = 10""",
    "requirement_scope": """
SELECT n_nationkey AS req_id, version_id FROM {nation} JOIN (
  SELECT version_id, count(*) FILTER (WHERE evidence_type IN ('license', 'test_indicator', 'dependency')) AS n FROM {evidence} WHERE version_id % 50 <= 2 GROUP BY version_id) AS told
  ON (n_nationkey = 17 AND n = 0) OR (n_nationkey = 3 AND version_id % 5 = 2)
UNION ALL SELECT n_nationkey, CAST(-1 AS BIGINT) FROM {nation} WHERE n_nationkey IN (24, 23)""",
    "project_constraint": """
SELECT n_nationkey AS project_id,
  CASE n_nationkey % 11 WHEN 0 THEN 'cpu_only' WHEN 1 THEN 'no_gpu' WHEN 2 THEN 'must_be_free_tier' WHEN 3 THEN 'must_be_local' WHEN 4 THEN 'always_off_at_night'
    WHEN 5 THEN 'budget_monthly_ceiling' WHEN 6 THEN 'license_allowlist' WHEN 7 THEN 'license_denylist' WHEN 8 THEN 'runtime_allowlist'
    WHEN 9 THEN 'component_kind_allowlist' ELSE 'colour' END AS kind,
  CASE WHEN n_nationkey % 2 = 0 THEN 20 ELSE NULL END AS amount_usd,
  CASE n_nationkey % 11 WHEN 6 THEN 'mit,apache-2.0' WHEN 7 THEN 'gpl-3.0,agpl-3.0' WHEN 8 THEN 'python_import,mcp_stdio' WHEN 9 THEN 'library,repo' ELSE NULL END AS listed
FROM {nation}""",
}

_NAME = re.compile(r"\{(\w+)\}")


def view(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A driver's table or a registry view of sf_dir. given are views that the caller has derived already, by name."""
    if name in given:
        return given[name]
    if name in TABLES:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "documents":
            df = df.select("doc_id", "text", "lang", "source", "n_chars")
        return df
    sql = VIEWS[name].replace("sha256(text)", "sha2(text, 256)")
    names = _NAME.findall(sql)
    plain = _NAME.sub("\0", sql).replace("{", "{{").replace("}", "}}").split("\0")  # other braces stand for themselves
    sql = plain[0] + "".join(f"{{{n}}}{rest}" for n, rest in zip(names, plain[1:]))
    return spark.sql(sql, **{n: view(spark, sf_dir, n, **given) for n in set(names)})


def with_views(sql: str) -> str:
    """sql for DuckDB, with the views that it names as {name} before it."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in _NAME.findall(text):
            if n in VIEWS and n not in order:
                need(VIEWS[n])
                order.append(n)

    need(sql)
    plain = lambda s: _NAME.sub(r"\1", s).strip()
    views = ",\n".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    body = plain(sql)
    if not views:
        return body
    return f"WITH {views},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {views}\n{body}"
