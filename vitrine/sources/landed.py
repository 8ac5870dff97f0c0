"""Landed files as component rows: repository listings, curated lists, server configs, front-matter notes and archives.

Every source reads a folder of many files in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LISTING = """full_name string, name string, owner struct<login:string>, description string, stargazers_count long, forks_count long, open_issues_count long,
watchers_count long, language string, topics array<string>, default_branch string, pushed_at string, updated_at string, html_url string, archived boolean,
disabled boolean, license struct<spdx_id:string>"""

#: First path segments of the host's own pages, which are no repository owners.
NON_REPO_OWNERS = (
    "topics", "trending", "settings", "orgs", "notifications", "features", "marketplace", "pricing", "about", "collections", "explore", "sponsors", "readme",
    "search", "login", "join", "pulls", "issues", "stars", "codespaces", "new", "organizations", "site", "assets", "blog", "actions",
)

#: Largest file of an archive and largest archive, in bytes.
MAX_FILE, MAX_ARCHIVE = 5 << 20, 200 << 20
#: Bytes of files after which a frame of them is handed on.
FRAME_BYTES = 8 << 20
#: A link to a repository (owner, name), and file endings that are no part of the name.
REPOSITORY_LINK = r"github\.com/([A-Za-z0-9](?:[A-Za-z0-9-]{0,38})?)/([A-Za-z0-9._-]{1,100})"
NO_NAME_ENDING = r"\.(git|md|png|jpg|jpeg|svg|gif)$"


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    return listing_rows(spark.read.schema(LISTING).json(path))


def listing_rows(items: DataFrame) -> DataFrame:
    """normalized_key, revision_key, licence, cost tier, outcome and the metadata of repository listings: without topics there
    is an empty list, without archived and disabled false, other missing keys are null. A row without owner or name is an error."""
    spdx = F.when(F.col("license.spdx_id") != "NOASSERTION", F.col("license.spdx_id"))
    bad = F.col("owner.login").isNull() | F.col("name").isNull()
    key = F.concat(F.lit("source:github:"), F.lower("owner.login"), F.lit("/"), F.lower("name"))
    outcome = F.when(bad, "error").when(F.coalesce("archived", F.lit(False)) | F.coalesce("disabled", F.lit(False)), "deprecated").otherwise("ok")
    return items.select(
        F.when(~bad, key).alias("normalized_key"), F.concat(F.lit("pushed:"), F.coalesce("pushed_at", "updated_at", F.lit("unknown"))).alias("revision_key"),
        spdx.alias("license_spdx"), F.lit("free").alias("cost_tier"), F.col("full_name").alias("github_full_name"), "description", F.col("stargazers_count").alias("stars"),
        F.col("forks_count").alias("forks"), F.col("open_issues_count").alias("open_issues"), F.col("watchers_count").alias("watchers"), "language",
        F.coalesce("topics", F.array().cast("array<string>")).alias("topics"), "default_branch", "pushed_at", "updated_at", "html_url",
        F.coalesce("archived", F.lit(False)).alias("archived"), F.coalesce("disabled", F.lit(False)).alias("disabled"), outcome.alias("outcome"),
    )


def repo_links(lists: DataFrame) -> DataFrame:
    """lists (list_id, text) to (list_id, pos, owner, name), first mention of each, with owners' case kept."""
    pattern = REPOSITORY_LINK
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), 1).alias("owner"), F.regexp_extract_all("text", F.lit(pattern), 2).alias("name"))
    rows = lists.select("list_id", F.posexplode(pairs).alias("pos", "p")).select("list_id", "pos", F.col("p.owner").alias("owner"), F.regexp_replace("p.name", NO_NAME_ENDING, "").alias("name"))
    rows = rows.where(~F.lower("owner").isin(*NON_REPO_OWNERS) & (F.lower(F.concat("owner", F.lit("/"), "name")) != F.lower("list_id")))
    first = Window.partitionBy("list_id", "owner", "name").orderBy("pos")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


SERVER = "struct<type:string,command:string,args:array<string>,url:string,env:map<string,string>>"


def server_configs(files: DataFrame) -> DataFrame:
    """files (path, content) of server configs to name, transport, env names, scopes: the first config of a name stands, all
    its scopes are listed, and scopes whose config differs are marked."""
    kind = f"mcpServers map<string,{SERVER}>, projects map<string,struct<mcpServers:map<string,{SERVER}>>>"
    parsed = files.select("path", F.from_json("content", kind).alias("j"))
    user = parsed.select("path", F.lit("user").alias("scope"), F.explode("j.mcpServers").alias("name", "c"))
    project = parsed.select("path", F.explode("j.projects").alias("scope", "p")).select("path", "scope", F.explode("p.mcpServers").alias("name", "c"))
    rows = user.withColumn("_o", F.lit(0)).unionByName(project.withColumn("_o", F.lit(1)))
    kind = F.lower("c.type")
    transport = F.when(kind.isin("stdio", "sse", "http"), kind).when(F.col("c.url").isNotNull(), "sse").when(F.col("c.command").isNotNull(), "stdio").otherwise("unknown")
    rows = rows.withColumn("transport", transport).withColumn("config", F.to_json("c")).withColumn("env_names", F.array_sort(F.coalesce(F.map_keys("c.env"), F.array().cast("array<string>"))))
    # the first config of a name is a least value, and scopes count once for each config: both are combined before the
    # shuffle, so a name that every file has is no task of its own
    rows = rows.groupBy("name", "scope", "config").agg(F.min(F.struct("_o", "scope", "path", "transport", "env_names", "config")).alias("least"))
    firsts = rows.groupBy("name").agg(F.min("least").alias("first")).select("name", "first.transport", "first.env_names", F.col("first.config").alias("_first"))
    shown = F.when(F.col("config") == F.col("_first"), F.col("scope")).otherwise(F.concat("scope", F.lit("#config-differs")))
    scopes = rows.join(firsts, "name").groupBy("name").agg(F.array_sort(F.collect_set(shown)).alias("scopes"))
    return firsts.drop("_first").join(scopes, "name")


def front_matter(files: DataFrame) -> DataFrame:
    """files (path, content) with a --- block to plugin, name, description, content hash and body lines; the first of each
    (plugin, name) by path; files without a name are left out."""
    head = F.regexp_extract("content", r"(?s)^---\n(.*?)\n---\n?(.*)$", 1)
    body = F.regexp_extract("content", r"(?s)^---\n(.*?)\n---\n?(.*)$", 2)
    field = lambda k: F.trim(F.regexp_replace(F.regexp_extract(F.col("_head"), rf"(?m)^{k}:[ \t]*(.*(?:\n[ \t]+.*)*)", 1), r"\n[ \t]+", " "))
    rows = files.withColumn("_head", head).select(
        "path", F.regexp_extract("path", r"([^/]+)/skills/", 1).alias("plugin"), field("name").alias("name"), field("description").alias("description"),
        F.left(F.sha2("content", 256), F.lit(16)).alias("content_hash"), F.size(F.split(body, "\n")).alias("body_lines"),
    )
    first = Window.partitionBy("plugin", "name").orderBy("path")
    return rows.where("name <> ''").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "path")


def archive_files(archives: DataFrame, max_file: int = MAX_FILE, max_archive: int = MAX_ARCHIVE) -> DataFrame:
    """archives (path, length, content) of tar files to (archive, path, size, content, outcome): a row for each regular file,
    without the leading folder. Files over max_file have their row without content, outcome too_large; an archive over
    max_archive is refused, and one that can't be read is broken, each with one row; what was read before the break stands."""

    def opened(batches):
        import io
        import tarfile
        import zlib

        import pandas as pd

        def files(name, content):
            try:
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                    for m in tar:
                        if m.isfile():
                            fits = m.size <= max_file
                            yield name, m.name.split("/", 1)[-1], m.size, tar.extractfile(m).read() if fits else None, "ok" if fits else "too_large"
            except (tarfile.TarError, EOFError, OSError, zlib.error):
                yield name, None, None, None, "broken"

        def frame(rows):
            return pd.DataFrame(rows, columns=["archive", "path", "size", "content", "outcome"]).astype({"size": "Int64"})

        for pdf in batches:
            out, held = [], 0
            for name, length, content in zip(pdf["path"], pdf["length"], pdf["content"]):
                for row in [(name, None, length, None, "refused")] if length > max_archive else files(name, content):
                    out.append(row)
                    held += len(row[3] or b"")
                    if held > FRAME_BYTES:  # small archives share a frame, whose bytes bound memory
                        yield frame(out)
                        out, held = [], 0
            if out:
                yield frame(out)

    schema = "archive string, path string, size long, content binary, outcome string"
    known = archives.where(F.col("length").isNotNull())
    # one pass over the archives; what is refused doesn't reach Python
    return known.select("path", "length", F.when(F.col("length") <= max_archive, F.col("content")).alias("content")).mapInPandas(opened, schema)


def matching_assets(assets: DataFrame, query: str) -> DataFrame:
    return assets.where(F.contains(F.lower("external_key"), F.lit(query.lower()))).orderBy("external_key")


def availability(known: DataFrame, observed: DataFrame) -> DataFrame:
    """known (asset, revision_key) against observed (asset, revision_key, blocked): blocked wins, then missing history."""
    rows = known.join(observed.select("asset", F.col("revision_key").alias("_seen"), "blocked"), "asset", "left")
    state = F.when(F.coalesce("blocked", F.lit(False)), "blocked").when(F.col("_seen").isNull(), "unavailable").when(F.col("_seen") == F.col("revision_key"), "unchanged").otherwise("changed")
    return rows.select("asset", state.alias("state"))
