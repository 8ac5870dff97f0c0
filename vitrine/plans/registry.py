"""Sources, sinks, identity, versions, links and data quality over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import registry as r
from vitrine.plans.catalogue import Catalogue
from vitrine.sources import landed, sinks
from vitrine.sources.folders import new_folder
from vitrine.sources.snapshots import SnapshotTable
from vitrine.sources.views import view

CATALOGUE = Catalogue()
add = CATALOGUE.add


@add("src1_scan", "SELECT p_partkey, p_name FROM {part} WHERE p_size > 40")
def src1_scan(spark, d):
    return view(spark, d, "part").where("p_size > 40").select("p_partkey", "p_name")


_LISTING_SQL = """SELECT CASE WHEN p_size % 9 <> 0 THEN 'source:github:brand' || CAST(p_size AS STRING) || '/' || lower(replace(p_name, ' ', '-')) END AS normalized_key,
  'pushed:' || CASE WHEN p_size % 3 = 0 THEN 'unknown' ELSE '2024-01-0' || CAST(p_size % 3 AS STRING) END AS revision_key, CASE WHEN p_size % 2 = 0 THEN 'MIT' END AS license_spdx, p_partkey AS stars,
  CASE WHEN p_size % 9 = 0 THEN 'error' WHEN p_size % 7 = 0 OR p_size % 11 = 0 THEN 'deprecated' ELSE 'ok' END AS outcome"""


@add("src2_listing", f"""{_LISTING_SQL}, 'free' AS cost_tier, CASE WHEN p_size % 9 <> 0 THEN 'Brand' || CAST(p_size AS STRING) || '/' || replace(p_name, ' ', '-') END AS github_full_name,
  CASE WHEN p_size % 5 <> 0 THEN p_name END AS description, CASE WHEN p_size % 4 <> 0 THEN p_partkey % 100 END AS forks, CASE WHEN p_size % 4 <> 1 THEN p_partkey % 10 END AS open_issues, p_partkey + 1 AS watchers,
  CASE WHEN p_size % 6 = 0 THEN 'Python' END AS language, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN p_type ELSE p_type || ',x' END AS topics, CASE WHEN p_size % 2 = 0 THEN 'main' END AS default_branch,
  CASE WHEN p_size % 3 = 1 THEN '2024-01-01' END AS pushed_at, CASE WHEN p_size % 3 = 2 THEN '2024-01-02' END AS updated_at, 'https://example.com/' || CAST(p_partkey AS STRING) AS html_url,
  coalesce(p_size % 7 = 0, FALSE) AS archived, p_size % 11 = 0 AS disabled FROM {{part}}""")
def src2_listing(spark, d):
    return _listed(spark, d).withColumn("topics", F.array_join("topics", ","))


@add("reg7_deprecation", _LISTING_SQL + " FROM {part}")
def reg7_deprecation(spark, d):
    return _listed(spark, d).select("normalized_key", "revision_key", "license_spdx", "stars", "outcome")


def _listed(spark, d):
    """Each part as a listing item in JSON, with keys left out here and there, parsed again with the listing's schema."""
    size, part = F.col("p_size"), F.col("p_partkey")
    owner, name = F.concat(F.lit("Brand"), size.cast("string")), F.replace("p_name", F.lit(" "), F.lit("-"))
    item = F.struct(
        F.when(size % 9 != 0, F.concat_ws("/", owner, name)).alias("full_name"), name.alias("name"), F.when(size % 9 != 0, F.struct(owner.alias("login"))).alias("owner"), F.when(size % 5 != 0, F.col("p_name")).alias("description"),
        part.alias("stargazers_count"), F.when(size % 4 != 0, part % 100).alias("forks_count"), F.when(size % 4 != 1, part % 10).alias("open_issues_count"), (part + 1).alias("watchers_count"), F.when(size % 6 == 0, "Python").alias("language"),
        F.when(size % 3 == 1, F.array("p_type")).when(size % 3 == 2, F.array(F.col("p_type"), F.lit("x"))).alias("topics"), F.when(size % 2 == 0, "main").alias("default_branch"), F.when(size % 3 == 1, "2024-01-01").alias("pushed_at"),
        F.when(size % 3 == 2, "2024-01-02").alias("updated_at"), F.concat(F.lit("https://example.com/"), part.cast("string")).alias("html_url"), F.when(size % 7 == 0, True).alias("archived"), F.when(size % 11 == 0, True).alias("disabled"),
        F.struct(F.when(size % 2 == 0, "MIT").otherwise("NOASSERTION").alias("spdx_id")).alias("license"),
    )
    return landed.listing_rows(view(spark, d, "part").select(F.from_json(F.to_json(item), landed.LISTING).alias("j")).select("j.*"))


@add("src3_links", "SELECT CAST(p_partkey AS STRING) AS list_id, p.o AS owner, p.n AS name FROM {part}, (VALUES ('Own', 'repo'), ('own', 'repo'), ('b', 'x.y')) AS p(o, n)")
def src3_links(spark, d):
    text = F.concat(F.lit("see https://github.com/Own/repo.git and github.com/own/repo, github.com/topics/ml, github.com/Own/repo/tree, [b](https://github.com/b/x.y) "), F.col("p_name"))
    return landed.repo_links(view(spark, d, "part").select(F.col("p_partkey").cast("string").alias("list_id"), text.alias("text"))).select("list_id", "owner", "name")


_SERVER_SQL = """
WITH f AS (SELECT 'f' || lpad(CAST(c_custkey AS STRING), 10, '0') AS path, 's' || CAST(c_custkey % 97 AS STRING) AS name, c_nationkey % 3 AS k, c_custkey % 4 AS own FROM {customer}),
c AS (SELECT path, name, 'user' AS scope, 0 AS o, CASE k WHEN 0 THEN 'stdio' WHEN 1 THEN 'sse' ELSE 'unknown' END AS transport, CASE k WHEN 0 THEN 'KEY' ELSE '' END AS env, k FROM f
  UNION ALL SELECT path, name, '/w', 1, 'stdio', '', 9 FROM f WHERE own = 0),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY o, scope, path) AS n FROM c) WHERE n = 1),
scopes AS (SELECT name, string_agg(DISTINCT shown, ',' ORDER BY shown) AS scopes FROM (SELECT c.name, CASE WHEN c.k = first.k THEN c.scope ELSE c.scope || '#config-differs' END AS shown FROM c JOIN first USING (name)) GROUP BY name)
SELECT name, transport, env, scopes FROM first JOIN scopes USING (name)"""


@add("src4_servers", _SERVER_SQL)
def src4_servers(spark, d):
    """Each customer as a config file with one server, of a name that many files have, every fourth also in a project with
    another config."""
    k, name = F.col("c_nationkey"), F.concat(F.lit("s"), (F.col("c_custkey") % 97).cast("string"))
    own = F.when(k % 3 == 0, '{"command": "run", "env": {"KEY": "hidden"}}').when(k % 3 == 1, '{"url": "http://x"}').otherwise("{}")
    server = F.concat(F.lit('{"'), name, F.lit('": '), own, F.lit("}"))
    other = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit('{"/w": {"mcpServers": {"'), name, F.lit('": {"command": "other"}}}}'))).otherwise("{}")
    content = F.concat(F.lit('{"mcpServers": '), server, F.lit(', "projects": '), other, F.lit("}"))
    path = F.concat(F.lit("f"), F.lpad(F.col("c_custkey").cast("string"), 10, "0"))
    rows = landed.server_configs(view(spark, d, "customer").select(path.alias("path"), content.alias("content")))
    return rows.select("name", "transport", F.array_join("env_names", ",").alias("env"), F.array_join("scopes", ",").alias("scopes"))


@add("src5_front_matter", "SELECT plugin, name, description, content_hash, body_lines FROM (SELECT 'p' || CAST(doc_id % 50 AS STRING) AS plugin, 'n' || CAST(doc_id % 300 AS STRING) AS name, 'two lines' AS description, left(sha256('---' || chr(10) || 'name: n' || CAST(doc_id % 300 AS STRING) || chr(10) || 'description: two' || chr(10) || '  lines' || chr(10) || '---' || chr(10) || text), 16) AS content_hash, CAST(len(string_split(text, chr(10))) AS INT) AS body_lines, row_number() OVER (PARTITION BY doc_id % 50, doc_id % 300 ORDER BY lpad(CAST(doc_id AS STRING), 12, '0')) AS n FROM {documents} WHERE doc_id % 4 <> 0) WHERE n = 1")
def src5_front_matter(spark, d):
    k = F.col("doc_id")
    path = F.concat(F.lit("p"), (k % 50).cast("string"), F.lit("/skills/"), F.lpad(k.cast("string"), 12, "0"), F.lit(".md"))
    name = F.when(k % 4 != 0, F.concat(F.lit("name: n"), (k % 300).cast("string"), F.lit("\n"))).otherwise("")
    content = F.concat(F.lit("---\n"), name, F.lit("description: two\n  lines\n---\n"), "text")
    return landed.front_matter(view(spark, d, "documents").select(path.alias("path"), content.alias("content")))


@add("src6_archives", "SELECT CAST(doc_id AS STRING) AS archive, CASE WHEN doc_id % 7 <> 3 THEN 'docs/' || CAST(doc_id AS STRING) || '.md' END AS path, CASE WHEN doc_id % 7 <> 3 THEN CAST(octet_length(encode(text)) AS BIGINT) END AS size, CASE WHEN doc_id % 7 <> 3 AND octet_length(encode(text)) <= 20000 THEN sha256(text) END AS content_hash, CASE WHEN doc_id % 7 = 3 THEN 'broken' WHEN octet_length(encode(text)) > 20000 THEN 'too_large' ELSE 'ok' END AS outcome FROM {documents}")
def src6_archives(spark, d):
    """Each document packed into an archive of its own and opened again; every seventh archive is cut short."""

    def packed(batches):
        import io
        import tarfile

        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                data, buffer = (text or "").encode(), io.BytesIO()
                with tarfile.open(fileobj=buffer, mode="w:gz", compresslevel=1) as tar:
                    m = tarfile.TarInfo(f"top/docs/{doc}.md")
                    m.size = len(data)
                    tar.addfile(m, io.BytesIO(data))
                out.append(buffer.getvalue()[: 15 if doc % 7 == 3 else None])
            yield pdf.assign(path=pdf["doc_id"].astype(str), length=[len(x) for x in out], content=out)[["path", "length", "content"]]

    # a table of few files, or of few row groups, is dealt to all cores
    archives = view(spark, d, "documents").select("doc_id", "text").repartition("doc_id").mapInPandas(packed, "path string, length long, content binary")
    return landed.archive_files(archives, 20_000).select("archive", "path", "size", F.sha2("content", 256).alias("content_hash"), "outcome")


@add("src7_assets", "SELECT s_name AS external_key FROM {supplier} WHERE contains(lower(s_name), 'r#00000000')")
def src7_assets(spark, d):
    return landed.matching_assets(view(spark, d, "supplier").select(F.col("s_name").alias("external_key")), "R#00000000")


@add("src8_availability", "SELECT s_suppkey AS asset, CASE WHEN s_suppkey % 5 = 0 AND s_suppkey % 4 <> 3 THEN 'blocked' WHEN s_suppkey % 4 = 3 THEN 'unavailable' WHEN s_suppkey % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM {supplier}")
def src8_availability(spark, d):
    k = F.col("asset")
    known = view(spark, d, "revision").select(F.col("revision_id").alias("asset"), "revision_key")
    seen = known.where(k % 4 != 3).select("asset", F.when(k % 3 == 0, "new").otherwise(F.col("revision_key")).alias("revision_key"), (k % 5 == 0).alias("blocked"))
    return landed.availability(known, seen)


_UPSERT = """SELECT coalesce(a.id, b.id) AS id, coalesce(b.display_name, a.display_name) AS display_name, coalesce(b.license_spdx, a.license_spdx) AS license_spdx,
  CASE WHEN b.id IS NULL THEN 'kept' WHEN a.id IS NULL THEN 'new' WHEN b.display_name IS NOT DISTINCT FROM a.display_name THEN 'unchanged' ELSE 'updated' END AS outcome
FROM (SELECT id, display_name, license_spdx FROM {capability} WHERE id % 4 <> 0) AS a
FULL JOIN (SELECT id, CASE WHEN id % 5 = 0 THEN display_name || '!' ELSE display_name END AS display_name, CAST(NULL AS STRING) AS license_spdx FROM {capability} WHERE id % 3 <> 0) AS b ON a.id = b.id"""


@add("snk1_upsert", _UPSERT)
@add("snk2_change_class", _UPSERT)
def snk1_upsert(spark, d):
    cap = view(spark, d, "capability").select("id", "display_name", "license_spdx")
    named = F.when(F.col("id") % 5 == 0, F.concat("display_name", F.lit("!"))).otherwise(F.col("display_name"))
    batch = cap.where("id % 3 <> 0").select("id", named.alias("display_name"), F.lit(None).cast("string").alias("license_spdx"))
    return r.upsert(cap.where("id % 4 <> 0"), batch, "id", ["display_name", "license_spdx"])


@add("snk3_children", """WITH f AS (SELECT DISTINCT version_id, name FROM {evidence} WHERE evidence_type = 'interface'), n AS (SELECT DISTINCT version_id, name FROM {evidence} WHERE evidence_type = 'dependency')
SELECT version_id, name FROM f WHERE version_id % 3 <> 0 UNION ALL SELECT version_id, name FROM n WHERE version_id % 6 = 0""")
def snk3_children(spark, d):
    """The interfaces of all versions as their children; then a third of the versions is derived again, half of it to nothing."""
    rows = view(spark, d, "evidence")
    of = lambda t: rows.where(F.col("evidence_type") == t).select("version_id", "name").distinct()
    table, versions = SnapshotTable(spark, new_folder(spark, "children"), "version_id"), rows.select("version_id").distinct()
    table.replace_children(of("interface"), versions)
    table.replace_children(of("dependency").where("version_id % 2 = 0"), versions.where("version_id % 3 = 0"))
    return table.read().select("version_id", "name")


@add("snk1_ordered", """
WITH o AS (SELECT o_custkey, struct_pack(d := o_orderdate, k := o_orderkey) AS seq, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM {orders})
SELECT o_custkey, arg_max(status, seq) AS status, arg_max(priority, seq) FILTER (priority IS NOT NULL) AS priority FROM o GROUP BY o_custkey""")
def snk1_ordered(spark, d):
    """The newest known values of every customer, merged from batches that come in the wrong order and in part twice."""
    kept = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))
    rows = view(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.col("o_orderstatus").alias("status"), kept.alias("priority"))
    table, columns, sequence = SnapshotTable(spark, new_folder(spark, "customers"), "o_custkey"), ["status", "priority"], ["o_orderdate", "o_orderkey"]
    for on in ("o_orderkey % 4 >= 2", "o_orderkey % 4 <= 2"):  # both hold the rows of 2
        table.merge(rows.where(on), columns, sequence)
    return table.values()


@add("snk2_ordered", """
WITH o AS (SELECT o_custkey, o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey) AS seq, o_orderstatus AS status FROM {orders}),
a AS (SELECT o_custkey, arg_max(status, seq) AS status FROM o WHERE o_orderkey % 4 <> 0 GROUP BY o_custkey),
b AS (SELECT o_custkey, arg_max(status, seq) AS status FROM o GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'new' WHEN a.status <> b.status THEN 'updated' ELSE 'unchanged' END AS outcome
FROM (SELECT DISTINCT o_custkey FROM o WHERE o_orderkey % 4 = 0) AS n JOIN b USING (o_custkey) LEFT JOIN a USING (o_custkey)""")
def snk2_ordered(spark, d):
    """What a late batch changes in what was known before."""
    rows = view(spark, d, "orders").withColumnRenamed("o_orderstatus", "status")
    states = lambda on: r.as_states(rows.where(on), "o_custkey", ["status"], ["o_orderdate", "o_orderkey"])
    return r.state_outcomes(states("o_orderkey % 4 <> 0"), states("o_orderkey % 4 = 0"), "o_custkey", ["status"])


@add("snk4_ledger", "SELECT event_id, step FROM {attempt} WHERE status = 'failed' UNION ALL SELECT event_id, step FROM {attempt} WHERE k % 2 = 0")
def snk4_ledger(spark, d):
    """Two batches appended to one ledger."""
    log, path = view(spark, d, "attempt"), new_folder(spark, "ledger")
    for on in ("status = 'failed'", "k % 2 = 0"):
        sinks.append(log.where(on).select("event_id", "step"), path)
    return spark.read.parquet(path)


@add("snk5_run_log", "SELECT 'events' AS source, 'completed' AS status, '{\"rows\": ' || CAST(count(*) AS STRING) || '}' AS counts, CAST(max(event_id) AS STRING) AS cursor FROM {attempt}")
def snk5_run_log(spark, d):
    """A run that counts its rows and tells its cursor."""
    path = new_folder(spark, "runs")
    with sinks.run_log(spark, path, "events") as told:
        n, last = view(spark, d, "attempt").agg(F.count("*"), F.max("event_id")).first()
        told["counts"]["rows"], told["cursor"] = n, str(last)
    return spark.read.parquet(path).select("source", "status", "counts", "cursor")


_MANIFESTS = """SELECT 'a' || CAST(p_partkey AS STRING) AS asset, CASE WHEN p_size % 3 = 0 THEN 'pypi:' || regexp_replace(lower(p_name), '[-_.]+', '-', 'g') WHEN p_size % 3 = 1 THEN 'npm:' || lower(p_name)
  ELSE 'source:github:a' || CAST(p_partkey AS STRING) END AS normalized_key FROM {part}"""


@add("reg1_identity", _MANIFESTS)
def reg1_identity(spark, d):
    """Four manifests of each part: a nested and a root pyproject.toml, a package.json and a file that is none."""
    part = view(spark, d, "part")
    size, name = F.col("p_size"), F.upper("p_name")
    none = F.lit(None).cast("string")
    files = F.array(*(F.struct(F.lit(p).alias("path"), n.alias("name")) for p, n in (
        ("sub/pyproject.toml", F.when(size % 3 == 0, F.lit("nested")).otherwise(none)), ("pyproject.toml", F.when(size % 3 == 0, name).otherwise(F.lit(" "))),
        ("package.json", F.when(size % 3 != 2, name).otherwise(none)), ("README.md", none))))
    rows = part.select(F.concat(F.lit("A"), F.col("p_partkey").cast("string")).alias("asset"), F.lit("github").alias("provider"), F.explode(files).alias("f")).select("asset", "provider", "f.*")
    return r.identities(rows).select(F.lower("asset").alias("asset"), "normalized_key")


@add("reg2_version_keys", "WITH h AS (SELECT revision, sha256(string_agg(path || chr(9) || content_hash || chr(10), '' ORDER BY path, content_hash)) AS h FROM {file} GROUP BY revision) SELECT revision, 'content:' || left(h, 16) AS version_key FROM h")
def reg2_version_keys(spark, d):
    return r.version_keys(r.content_hashes(view(spark, d, "file")))


@add("reg3_promotable", "SELECT revision_id FROM {revision} WHERE snapshot_status = 'snapshotted' AND content_hash IS NOT NULL AND revision_id NOT IN (SELECT l_suppkey FROM {lineitem} WHERE l_suppkey % 3 = 0)")
def reg3_promotable(spark, d):
    bound = view(spark, d, "lineitem").where("l_suppkey % 3 = 0").select(F.col("l_suppkey").alias("revision_id"))
    return r.promotable(view(spark, d, "revision"), bound).select("revision_id")


@add("reg4_denormalised", "SELECT evidence_id, version_id, evidence_type, name, coalesce(signature, '') AS signature FROM {evidence} WHERE evidence_type IN ('interface', 'dependency')")
def reg4_denormalised(spark, d):
    rows = view(spark, d, "evidence").where("evidence_type in ('interface', 'dependency')")
    return rows.select("evidence_id", "version_id", "evidence_type", "name", F.coalesce("signature", F.lit("")).alias("signature"))


@add("reg6_revision_versions", "SELECT DISTINCT 'revision:' || CAST(revision_id AS STRING) AS version_key, revision_id FROM {revision} WHERE revision_id NOT IN (SELECT l_suppkey FROM {lineitem} WHERE l_suppkey % 3 = 0)")
def reg6_revision_versions(spark, d):
    """A version of its own for each revision that has none; nothing is superseded."""
    have = view(spark, d, "lineitem").where("l_suppkey % 3 = 0").select(F.col("l_suppkey").alias("revision_id")).distinct()
    rows = view(spark, d, "revision").join(have, "revision_id", "left_anti")
    return rows.select(F.concat(F.lit("revision:"), F.col("revision_id").cast("string")).alias("version_key"), "revision_id")


@add("dq1_rules", """SELECT id, 'cost_tier_domain' AS rule FROM {capability} WHERE coalesce(cost_tier, '?') NOT IN ('free', 'cheap_paid', 'paid') UNION ALL SELECT id, 'runtime_given' FROM {capability} WHERE runtime IS NULL""")
def dq1_rules(spark, d):
    rules = {"cost_tier_domain": F.col("cost_tier").isin("free", "cheap_paid", "paid"), "runtime_given": F.col("runtime").isNotNull(), "name_given": F.trim("display_name") != ""}
    return r.violations(view(spark, d, "capability"), "id", rules)


@add("dq1_unique", "SELECT normalized_key, count(*) AS n FROM {capability} GROUP BY normalized_key HAVING count(*) > 1")
def dq1_unique(spark, d):
    return r.duplicates(view(spark, d, "capability"), "normalized_key")
