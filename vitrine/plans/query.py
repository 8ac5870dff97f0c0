"""Search, browse, detail, report and filter queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from vitrine.operators import policy, query as q, scoring, textindex
from vitrine.plans.catalogue import Catalogue
from vitrine.plans.common import DIMENSION_SQL, HEAD_SQL
from vitrine.sources.folders import new_folder
from vitrine.sources.views import view

CATALOGUE = Catalogue()
SHOWN = "id, display_name, component_kind, version_id, total_score"
_SCORED = f"WITH {DIMENSION_SQL.strip()}, {HEAD_SQL.strip()}"
_ORDER = "ORDER BY coalesce(total_score, 0) DESC, display_name, id"


def _tables(spark, d):
    return view(spark, d, "capability"), view(spark, d, "capability_version"), view(spark, d, "evidence")


def _shown(df):
    return df.select(*SHOWN.split(", "))


@CATALOGUE.add("qry1_search", f"{_SCORED} SELECT {SHOWN} FROM scored WHERE component_kind = 'repo' AND (display_name ILIKE '%ring%' OR normalized_key ILIKE '%ring%') {_ORDER} LIMIT 100")
def qry1_search(spark, d):
    return _shown(q.search(*_tables(spark, d), "Ring ", limit=1000, component_kind="repo"))


def text_index(spark, d):
    """A text index over names and keys of all components, made for this query."""
    path = new_folder(spark, "text-index")
    textindex.build(view(spark, d, "capability"), ["display_name", "normalized_key"], path)
    return path


@CATALOGUE.add("qry1_indexed", f"{_SCORED} SELECT {SHOWN} FROM scored WHERE display_name ILIKE '%purple ri%' OR normalized_key ILIKE '%purple ri%' {_ORDER} LIMIT 100")
def qry1_indexed(spark, d):
    """A search through the posting lists of its rarest trigrams."""
    return _shown(q.search(*_tables(spark, d), "Purple RI", limit=100, index=text_index(spark, d)))


PHRASES = ("ring", "R%d w_dg", "-wid", "no such thing", "r_d", "%")


@CATALOGUE.add("fil2_indexed", "WITH p AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(PHRASES)) + ") AS p(n, phrase)) SELECT n, id FROM p JOIN {capability} ON display_name ILIKE '%' || phrase || '%' OR normalized_key ILIKE '%' || phrase || '%'")
def fil2_indexed(spark, d):
    """Substrings through the text index, with wildcards, without any gram, and one that isn't there."""
    cap, path = view(spark, d, "capability"), text_index(spark, d)
    found = [textindex.narrowed(cap, path, p).where(q.matching(p)).select(F.lit(i).alias("n"), "id") for i, p in enumerate(PHRASES)]
    return reduce(lambda a, b: a.unionByName(b), found)


@CATALOGUE.add("qry2_browse", f"{_SCORED} SELECT {SHOWN} FROM scored WHERE component_kind = 'library' {_ORDER} LIMIT 50")
def qry2_browse(spark, d):
    return _shown(q.browse(*_tables(spark, d), component_kind="library"))


@CATALOGUE.add("fil1_filters", "SELECT id, normalized_key FROM {capability} WHERE ecosystem = 'source' AND runtime = 'mcp_stdio' AND cost_tier = 'free'")
def fil1_filters(spark, d):
    return q.where_given(view(spark, d, "capability"), ecosystem="source", runtime="mcp_stdio", cost_tier="free", kind=None).select("id", "normalized_key")


@CATALOGUE.add("fil2_substring", "SELECT id, display_name FROM {capability} WHERE display_name ILIKE '%r_d%' OR normalized_key ILIKE '%r_d%'")
def fil2_substring(spark, d):
    return view(spark, d, "capability").where(q.matching("R_D")).select("id", "display_name")


@CATALOGUE.add("fil3_clamp", "SELECT id FROM {capability} ORDER BY id LIMIT 100")
def fil3_clamp(spark, d):
    return view(spark, d, "capability").orderBy("id").limit(q.clamp(5000, 100)).select("id")


@CATALOGUE.add("fil4_key_exists", "SELECT id FROM {capability} WHERE gemini_description IS NOT NULL")
def fil4_key_exists(spark, d):
    meta = F.to_json(F.struct("description", "gemini_description", "transport"))
    return view(spark, d, "capability").withColumn("metadata", meta).where(F.array_contains(F.json_object_keys("metadata"), "gemini_description")).select("id")


@CATALOGUE.add("fil5_json_path", "SELECT event_id, coalesce(CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS INT), -1) AS k FROM {events}")
def fil5_json_path(spark, d):
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(-1))
    return view(spark, d, "events").select("event_id", k.alias("k"))


@CATALOGUE.add("fil6_membership", "SELECT id FROM {capability} WHERE id IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 45)")
def fil6_membership(spark, d):
    keys = view(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return view(spark, d, "capability").join(keys, "id", "left_semi").select("id")


@CATALOGUE.add("fil7_json_safe", """SELECT o_orderkey, '{"n":"' || o_orderpriority || '","s":"' || o_orderstatus || '","c":' || CAST(o_custkey AS STRING) || ',"d":"' || strftime(o_orderdate, '%Y-%m-%d') || '"}' AS doc FROM {orders}""")
def fil7_json_safe(spark, d):
    safe = F.struct(F.col("o_orderpriority").alias("n"), F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("c"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return view(spark, d, "orders").select("o_orderkey", F.to_json(safe).alias("doc"))


@CATALOGUE.add(
    "fil8_json_merge",
    "SELECT id, 'yes' AS deprecated, CASE WHEN id % 2 = 0 THEN 'patched' ELSE description END AS description, transport FROM {capability}",
)
def fil8_json_merge(spark, d):
    cap = view(spark, d, "capability")
    patch = F.when(F.col("id") % 2 == 0, F.map_from_arrays(F.array(F.lit("deprecated"), F.lit("description")), F.array(F.lit("yes"), F.lit("patched")))).otherwise(
        F.map_from_arrays(F.array(F.lit("deprecated")), F.array(F.lit("yes")))
    )
    old = F.map_from_arrays(F.array(F.lit("description"), F.lit("transport")), F.array("description", "transport"))
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(patch, k))
    merged = cap.select("id", F.map_concat(kept, patch).alias("m"))
    return merged.select("id", *(F.col("m")[k].alias(k) for k in ("deprecated", "description", "transport")))


@CATALOGUE.add("jon3_head_score", f"{_SCORED} SELECT id, version_id, total_score, confidence FROM scored")
def jon3_head_score(spark, d):
    return q.with_head(*_tables(spark, d)).select("id", "version_id", "total_score", "confidence")


@CATALOGUE.add("win3_heads", "SELECT capability_id, max(version_id) AS version_id FROM {capability_version} GROUP BY capability_id")
def win3_heads(spark, d):
    return q.heads(view(spark, d, "capability_version")).select("capability_id", "version_id")


@CATALOGUE.add("ord1_top", f"{_SCORED} SELECT id, display_name, total_score FROM scored {_ORDER} LIMIT 25")
def ord1_top(spark, d):
    return q.best_first(q.with_head(*_tables(spark, d)), 25).select("id", "display_name", "total_score")


_DETAIL_SQL = f"""{_SCORED},
f AS (SELECT version_id, CAST(to_json(list({{{{'name': name, 'evidence_id': evidence_id, 'signature': signature}}}} ORDER BY name, evidence_id)) AS VARCHAR) AS interfaces FROM {{evidence}} WHERE evidence_type = 'interface' GROUP BY version_id),
p AS (SELECT version_id, CAST(to_json(list({{{{'ecosystem': ecosystem, 'name': name, 'evidence_id': evidence_id}}}} ORDER BY ecosystem, name, evidence_id)) AS VARCHAR) AS dependencies FROM {{evidence}} WHERE evidence_type = 'dependency' GROUP BY version_id),
k AS (SELECT version_id, to_json(list({{{{'name': dimension, 'evidence_count': n, 'raw': CAST(raw AS VARCHAR), 'weight': CAST(CAST(weight AS DECIMAL(4,3)) AS VARCHAR), 'weighted': CAST(CAST(round(raw * weight, 3) AS DECIMAL(18,3)) AS VARCHAR),
    'coverage': CAST(n > 0 AS INT), 'contradiction': contradiction}}}} ORDER BY dimension)) AS dimensions FROM dims GROUP BY version_id)
SELECT id, s.version_id, coalesce(interfaces, '[]') AS interfaces, coalesce(dependencies, '[]') AS dependencies,
  CASE WHEN s.version_id IS NOT NULL THEN '{{{{"total_score":"' || CAST(total_score AS VARCHAR) || '","confidence":"' || CAST(confidence AS VARCHAR) || '","dimensions":' || CAST(dimensions AS VARCHAR) || '}}}}' END AS scorecard
FROM scored AS s LEFT JOIN f ON f.version_id = s.version_id LEFT JOIN p ON p.version_id = s.version_id LEFT JOIN k ON k.version_id = s.version_id"""
# braces that stand for themselves, not for a view
_DETAIL_SQL = _DETAIL_SQL.replace("{{", "{").replace("}}", "}")


@CATALOGUE.add("qry3_detail", _DETAIL_SQL)
@CATALOGUE.add("agg10_nested_detail", _DETAIL_SQL)
def qry3_detail(spark, d):
    """The documents, their nested parts as JSON."""
    rows = q.detail(*_tables(spark, d))
    shown = lambda c: F.to_json(c, {"ignoreNullFields": "false"}).alias(c)
    return rows.select("id", "version_id", *map(shown, ("interfaces", "dependencies", "scorecard")))


CHECK_SQL = """
c AS (SELECT c.id AS capability_id, c.*, p.project_id, p.kind AS ckind, p.amount_usd, p.listed, lower(coalesce(c.runtime, '')) AS rt, lower(coalesce(c.cost_tier, '')) AS tier,
    string_split(lower(coalesce(c.topics, '')), ',') AS tags, string_split(coalesce(p.listed, ''), ',') AS names
  FROM {capability} AS c CROSS JOIN {project_constraint} AS p),
verdicts AS (
  SELECT capability_id, project_id, CASE ckind WHEN 'cpu_only' THEN 'no_gpu' ELSE ckind END AS kind, c.* EXCLUDE (capability_id, project_id, kind),
    CASE ckind
      WHEN 'must_be_free_tier' THEN CASE WHEN tier IN ('paid', 'cheap_paid') THEN 'paid' WHEN tier IN ('', 'unknown') THEN 'unknown_cost' ELSE 'ok' END
      WHEN 'must_be_local' THEN CASE WHEN rt IN ('http_endpoint', 'mcp_http', 'mcp_sse') THEN 'remote_runtime' ELSE 'ok' END
      WHEN 'always_off_at_night' THEN CASE WHEN rt IN ('http_endpoint', 'mcp_http', 'mcp_sse') THEN 'remote_runtime'
        WHEN list_has_any(tags, ['celery', 'airflow', 'kafka', 'rabbitmq', 'cron', 'scheduler']) THEN 'requires_broker' ELSE 'ok' END
      WHEN 'budget_monthly_ceiling' THEN CASE WHEN amount_usd IS NULL THEN 'no_ceiling' WHEN monthly_cost_usd IS NULL THEN 'unknown_cost' WHEN monthly_cost_usd > amount_usd THEN 'over_budget' ELSE 'ok' END
      WHEN 'license_allowlist' THEN CASE WHEN coalesce(license_spdx, '') = '' THEN 'unknown_license' WHEN NOT list_contains(names, lower(license_spdx)) THEN 'license_not_allowed' ELSE 'ok' END
      WHEN 'license_denylist' THEN CASE WHEN coalesce(license_spdx, '') = '' THEN 'unknown_license' WHEN list_contains(names, lower(license_spdx)) THEN 'license_denied' ELSE 'ok' END
      WHEN 'runtime_allowlist' THEN CASE WHEN rt = '' THEN 'unknown_runtime' WHEN NOT list_contains(names, rt) THEN 'runtime_not_allowed' ELSE 'ok' END
      WHEN 'component_kind_allowlist' THEN CASE WHEN NOT list_contains(names, component_kind) THEN 'kind_not_allowed' ELSE 'ok' END
      WHEN 'cpu_only' THEN CASE WHEN requires_gpu THEN 'gpu_required' WHEN list_has_any(tags, ['gpu', 'cuda', 'nvidia', 'rocm', 'tensorrt']) THEN 'gpu_topic' ELSE 'ok' END
      WHEN 'no_gpu' THEN CASE WHEN requires_gpu THEN 'gpu_required' WHEN list_has_any(tags, ['gpu', 'cuda', 'nvidia', 'rocm', 'tensorrt']) THEN 'gpu_topic' ELSE 'ok' END
      ELSE 'unknown_constraint_kind' END AS reason
  FROM c),
judged AS (SELECT *, reason IN ('ok', 'unknown_cost', 'no_ceiling', 'unknown_license', 'unknown_runtime', 'unknown_constraint_kind') AS passed FROM verdicts)"""
_DETAILS = """CASE reason WHEN 'gpu_required' THEN 'requires_gpu is set' WHEN 'gpu_topic' THEN 'topics ' || array_to_string(list_sort(list_distinct(list_intersect(tags, ['gpu', 'cuda', 'nvidia', 'rocm', 'tensorrt']))), ',')
    WHEN 'requires_broker' THEN 'topics ' || array_to_string(list_sort(list_distinct(list_intersect(tags, ['celery', 'airflow', 'kafka', 'rabbitmq', 'cron', 'scheduler']))), ',')
    WHEN 'paid' THEN 'cost_tier=' || cost_tier WHEN 'remote_runtime' THEN 'runtime=' || runtime WHEN 'over_budget' THEN '$' || CAST(monthly_cost_usd AS STRING) || ' > $' || CAST(amount_usd AS STRING)
    WHEN 'license_not_allowed' THEN license_spdx || ' not in allowlist' WHEN 'license_denied' THEN license_spdx || ' on denylist' WHEN 'unknown_license' THEN 'license_spdx missing'
    WHEN 'runtime_not_allowed' THEN runtime || ' not in allowlist' WHEN 'unknown_runtime' THEN 'runtime missing' WHEN 'kind_not_allowed' THEN component_kind || ' not in allowlist'
    WHEN 'unknown_cost' THEN CASE ckind WHEN 'must_be_free_tier' THEN 'cost_tier missing' ELSE 'monthly_cost_usd missing' END ELSE '' END AS detail"""


def _verdicts(spark, d):
    return policy.constraint_verdicts(view(spark, d, "capability"), view(spark, d, "project_constraint"))


_VERDICT_SQL = f"WITH {CHECK_SQL.strip()} SELECT capability_id, project_id, kind, passed, reason, {_DETAILS} FROM judged"


@CATALOGUE.add("pol8_constraints", _VERDICT_SQL)
@CATALOGUE.add("jon13_constraints", _VERDICT_SQL)
def pol8_constraints(spark, d):
    return _verdicts(spark, d)


_OF_PROJECT = "id NOT IN (SELECT capability_id FROM judged WHERE project_id = {} AND NOT passed)"


@CATALOGUE.add("pol9_filtered_browse", f"{_SCORED}, {CHECK_SQL.strip()}, b AS (SELECT {SHOWN} FROM scored WHERE component_kind = 'repo' {_ORDER} LIMIT 200) SELECT * FROM b WHERE {_OF_PROJECT.format(4)}")
@CATALOGUE.add("qry2_browse_project", f"{_SCORED}, {CHECK_SQL.strip()}, b AS (SELECT {SHOWN} FROM scored WHERE component_kind = 'repo' {_ORDER} LIMIT 200) SELECT * FROM b WHERE {_OF_PROJECT.format(4)}")
def pol9_filtered_browse(spark, d):
    return _shown(q.browse(*_tables(spark, d), limit=200, constraints=view(spark, d, "project_constraint"), project_id=4, component_kind="repo"))


@CATALOGUE.add("qry1_search_project", f"{_SCORED}, {CHECK_SQL.strip()}, b AS (SELECT {SHOWN} FROM scored WHERE display_name ILIKE '%red%' OR normalized_key ILIKE '%red%' {_ORDER} LIMIT 100) SELECT * FROM b WHERE {_OF_PROJECT.format(8)}")
def qry1_search_project(spark, d):
    return _shown(q.search(*_tables(spark, d), "red", limit=100, constraints=view(spark, d, "project_constraint"), project_id=8))


_FIT_SQL = f"WITH {CHECK_SQL.strip()} SELECT capability_id, project_id, NOT bool_and(passed) AS hard_fail, coalesce(string_agg(CASE WHEN NOT passed THEN reason END, ',' ORDER BY reason), '') AS failed FROM judged GROUP BY capability_id, project_id"


@CATALOGUE.add("pol10_fit_report", _FIT_SQL)
@CATALOGUE.add("qry4_constraint_fit", _FIT_SQL)
def pol10_fit_report(spark, d):
    return policy.constraint_fit(_verdicts(spark, d))


@CATALOGUE.add("win9_interface", "WITH h AS (SELECT capability_id, max(version_id) AS version_id FROM {capability_version} GROUP BY capability_id) SELECT capability_id, name, signature FROM (SELECT capability_id, name, signature, row_number() OVER (PARTITION BY capability_id ORDER BY name, signature NULLS FIRST) AS n FROM {evidence} JOIN h USING (version_id) WHERE evidence_type = 'interface') WHERE n = 1")
def win9_interface(spark, d):
    return q.representative_interface(view(spark, d, "evidence"), view(spark, d, "capability_version"))


_HEALTH_SQL = """
WITH n AS (SELECT *, len(list_filter([gemini_description, description, content_hash, topics, language, html_url, seed_note], lambda x: coalesce(x, '') <> '')) AS filled FROM {capability}),
raw AS (
  SELECT id, component_kind, CASE WHEN days_old IS NULL THEN 0.5::DOUBLE ELSE greatest(0, least(1, 1 - days_old / 730.0::DOUBLE)) END AS fresh,
    CASE WHEN stars IS NULL THEN 0.5::DOUBLE WHEN stars <= 0 THEN 0 ELSE greatest(0, least(1, log10(stars + 1) / 4.0::DOUBLE)) END AS pop,
    CASE WHEN open_issues IS NULL AND forks IS NULL THEN 0.5::DOUBLE ELSE CASE WHEN open_issues > 0 THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN forks > 0 THEN 0.5::DOUBLE ELSE 0 END END AS act,
    CASE WHEN license_spdx IS NOT NULL THEN 1::DOUBLE ELSE 0.3 END AS lic,
    CASE WHEN gemini_description IS NOT NULL THEN 1::DOUBLE WHEN description IS NOT NULL OR seed_note IS NOT NULL THEN 0.6 ELSE 0 END AS descr,
    CASE WHEN ecosystem IN ('pypi', 'npm') THEN 1::DOUBLE ELSE 0.5 END AS eco, greatest(0, least(1, filled / 4.0::DOUBLE)) AS complete,
    CASE WHEN transport IN ('stdio', 'sse', 'http') THEN 1::DOUBLE ELSE 0.3 END AS trans,
    CAST(days_old IS NOT NULL AS INT) AS e1, CAST(stars IS NOT NULL AS INT) AS e2, CAST(open_issues IS NOT NULL OR forks IS NOT NULL AS INT) AS e3, CAST(filled > 0 AS INT) AS e4
  FROM n),
health AS (SELECT id AS capability_id, component_kind || '_health' AS profile_name,
  least(1.0::DOUBLE, CAST(round(CASE component_kind WHEN 'repo' THEN CAST(round(fresh * 0.3::DOUBLE, 4) AS DECIMAL(18,4)) + CAST(round(pop * 0.3::DOUBLE, 4) AS DECIMAL(18,4)) + CAST(round(act * 0.1::DOUBLE, 4) AS DECIMAL(18,4)) + CAST(round(lic * 0.15::DOUBLE, 4) AS DECIMAL(18,4)) + CAST(round(descr * 0.15::DOUBLE, 4) AS DECIMAL(18,4))
    WHEN 'library' THEN CAST(round(lic * 0.35::DOUBLE, 4) AS DECIMAL(18,4)) + CAST(round(descr * 0.4::DOUBLE, 4) AS DECIMAL(18,4)) + CAST(round(eco * 0.25::DOUBLE, 4) AS DECIMAL(18,4))
    WHEN 'skill' THEN CAST(round(complete * 0.5::DOUBLE, 4) AS DECIMAL(18,4)) + CAST(round(descr * 0.4::DOUBLE, 4) AS DECIMAL(18,4)) + CAST(round(lic * 0.1::DOUBLE, 4) AS DECIMAL(18,4))
    WHEN 'mcp_tool' THEN CAST(round(trans * 0.6::DOUBLE, 4) AS DECIMAL(18,4)) + CAST(round(descr * 0.4::DOUBLE, 4) AS DECIMAL(18,4)) WHEN 'agent' THEN CAST(round(descr, 4) AS DECIMAL(18,4)) ELSE CAST(round(complete, 4) AS DECIMAL(18,4)) END, 3) AS DOUBLE)) AS total,
  round(CASE component_kind WHEN 'repo' THEN (e1 + e2 + e3 + 2) / 5.0::DOUBLE WHEN 'skill' THEN (e4 + 2) / 3.0::DOUBLE WHEN 'workflow_template' THEN e4::DOUBLE ELSE 1 END, 3) AS confidence
FROM raw)"""


@CATALOGUE.add("sco6_health", f"{_HEALTH_SQL} SELECT * FROM health")
@CATALOGUE.add("sco7_health_confidence", f"{_HEALTH_SQL} SELECT * FROM health")
def sco6_health(spark, d):
    return scoring.health_scores(view(spark, d, "capability"))


@CATALOGUE.add("sco8_score_changes", f"{_HEALTH_SQL} SELECT capability_id, total, CASE WHEN capability_id % 3 = 0 THEN 'new' WHEN capability_id % 3 = 1 THEN 'unchanged' ELSE 'updated' END AS outcome FROM health")
def sco8_score_changes(spark, d):
    new = scoring.health_scores(view(spark, d, "capability"))
    old = new.where("capability_id % 3 <> 0").withColumn("total", F.when(F.col("capability_id") % 3 == 1, F.col("total")).otherwise(F.col("total") + 1))
    return scoring.score_changes(new, old).select("capability_id", "total", "outcome")


_INFO_SQL = f"""{_HEALTH_SQL}
SELECT 'kind' AS section, component_kind AS name, CAST(count(*) AS DOUBLE) AS value FROM {{capability}} GROUP BY component_kind
UNION ALL SELECT 'tier', cost_tier, CAST(count(*) AS DOUBLE) FROM {{capability}} GROUP BY cost_tier
UNION ALL SELECT 'top', CAST(capability_id AS STRING), total FROM (SELECT * FROM health ORDER BY total DESC, capability_id LIMIT 10)"""


@CATALOGUE.add("qry6_info", _INFO_SQL)
@CATALOGUE.add("agg2_info", _INFO_SQL)
def qry6_info(spark, d):
    cap = view(spark, d, "capability")
    return q.info(cap, scoring.health_scores(cap))


#: Whether runtimes s and t call each other directly, or an adapter bridges them.
NATIVE_SQL = "CASE WHEN s = t THEN TRUE WHEN s LIKE 'mcp%' AND t LIKE 'mcp%' THEN TRUE WHEN s LIKE 'claude%' AND t LIKE 'claude%' THEN TRUE WHEN s = 'http_endpoint' AND t IN ('mcp_http', 'mcp_sse') THEN TRUE ELSE FALSE END"
BRIDGE_SQL = """s || '>' || t IN ('python_import>cli_subprocess', 'cli_subprocess>python_import', 'python_import>http_endpoint', 'http_endpoint>python_import', 'npm_import>http_endpoint', 'http_endpoint>npm_import',
    'python_import>mcp_stdio', 'mcp_stdio>python_import', 'cli_subprocess>http_endpoint', 'http_endpoint>cli_subprocess', 'git_clone>python_import', 'git_clone>cli_subprocess', 'claude_skill>mcp_stdio',
    'claude_agent>mcp_stdio', 'claude_skill>python_import', 'claude_agent>python_import')"""
HINT_SQL = """CASE s || '>' || t WHEN 'python_import>cli_subprocess' THEN 'subprocess.run() call, capture stdout' WHEN 'cli_subprocess>python_import' THEN 'subprocess.run() call, capture stdout'
    WHEN 'python_import>http_endpoint' THEN 'httpx.Client call' WHEN 'http_endpoint>python_import' THEN 'httpx.Client call' WHEN 'npm_import>http_endpoint' THEN 'fetch() call' WHEN 'http_endpoint>npm_import' THEN 'fetch() call'
    WHEN 'python_import>mcp_stdio' THEN 'mcp.ClientSession + stdio_client' WHEN 'mcp_stdio>python_import' THEN 'mcp.ClientSession + stdio_client' WHEN 'git_clone>python_import' THEN 'pip install -e . after clone'
    WHEN 'git_clone>cli_subprocess' THEN 'clone then run the CLI binary from the tree' WHEN 'claude_skill>mcp_stdio' THEN 'skill invokes the MCP tool by name' WHEN 'claude_agent>mcp_stdio' THEN 'agent calls the tool via its MCP client'
    ELSE 'generic glue script' END"""
_PAIR_SQL = f"""
WITH f AS (SELECT capability_id, name, signature FROM (SELECT capability_id, name, signature, row_number() OVER (PARTITION BY capability_id ORDER BY name, signature NULLS FIRST) AS n
    FROM {{evidence}} JOIN (SELECT capability_id, max(version_id) AS version_id FROM {{capability_version}} GROUP BY capability_id) USING (version_id) WHERE evidence_type = 'interface') WHERE n = 1),
p AS (SELECT a.id AS src, b.id AS tgt, a.runtime AS s, b.runtime AS t, fa.name AS sk, fb.name AS tk
  FROM {{capability}} AS a JOIN {{capability}} AS b ON b.id = a.id + 1 LEFT JOIN f AS fa ON fa.capability_id = a.id LEFT JOIN f AS fb ON fb.capability_id = b.id),
x AS (SELECT *, CASE WHEN sk IS NULL OR tk IS NULL THEN 'unknown_io' WHEN sk <> tk THEN 'mismatch' ELSE 'match' END AS io_type_check,
  {NATIVE_SQL} AS native,
  {BRIDGE_SQL} AS bridge FROM p)
SELECT src, tgt, io_type_check, CASE WHEN s IS NULL OR t IS NULL OR bridge OR (native AND io_type_check = 'mismatch') THEN 'adapter_needed' WHEN native THEN 'compatible' ELSE 'incompatible' END AS verdict,
  CASE WHEN s IS NULL OR t IS NULL THEN 'unknown_runtime' WHEN native AND io_type_check = 'mismatch' THEN 'io_mismatch_within_family' WHEN native THEN 'same_family' WHEN bridge THEN 'bridge_available' ELSE 'no_known_bridge' END AS reason,
  CASE WHEN s IS NULL OR t IS NULL THEN 'one side has no declared runtime; assume glue' WHEN native AND io_type_check = 'mismatch' THEN 'write a type transformer' WHEN native THEN '' WHEN bridge THEN {HINT_SQL} ELSE '' END AS adapter_hint,
  coalesce(s, '') || CASE WHEN native AND io_type_check = 'mismatch' THEN ' <-> ' || t || ' runtime-compatible but I/O types differ' ELSE ' -> ' || coalesce(t, '') END AS detail
FROM x"""


@CATALOGUE.add("pol11_compatibility", _PAIR_SQL)
@CATALOGUE.add("qry5_compatibility", _PAIR_SQL)
@CATALOGUE.add("jon10_runtime_matrix", _PAIR_SQL)
def pol11_compatibility(spark, d):
    """Each component with the next one, whose interface names stand for the kinds of their outputs and inputs."""
    cap = view(spark, d, "capability").select("id", "runtime")
    face = q.representative_interface(view(spark, d, "evidence"), view(spark, d, "capability_version"))
    null = F.lit(None).cast("string")
    rows = cap.join(face.withColumnRenamed("capability_id", "id"), "id", "left").select("id", "runtime", F.when(F.col("name").isNotNull(), F.struct(F.col("name").alias("kind"), null.alias("type"), null.alias("of"))).alias("io"))
    src = rows.select(F.col("id").alias("src"), (F.col("id") + 1).alias("tgt"), F.col("runtime").alias("src_runtime"), F.col("io").alias("src_output"))
    tgt = rows.select(F.col("id").alias("tgt"), F.col("runtime").alias("tgt_runtime"), F.col("io").alias("tgt_input"))
    return policy.compatibility(src.join(tgt, "tgt")).select("src", "tgt", "io_type_check", "verdict", "reason", "adapter_hint", "detail")
