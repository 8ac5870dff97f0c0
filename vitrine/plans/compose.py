"""Stage candidates, pipeline proposals, environment hints and the model hook."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators.policy import compatibility
from vitrine.operators.query import fitting

#: Environment variables by runtime and by a token of the key.
RUNTIME_ENV = {"mcp_sse": ("MCP_SERVER_URL",), "mcp_http": ("MCP_SERVER_URL",), "http_endpoint": ("API_BASE_URL", "API_KEY")}
TOKEN_ENV = {
    "openai": "OPENAI_API_KEY", "anthropic": "ANTHROPIC_API_KEY", "gemini": "GEMINI_API_KEY", "sentry": "SENTRY_DSN", "auth0": "AUTH0_DOMAIN",
    "aws": "AWS_ACCESS_KEY_ID", "boto": "AWS_ACCESS_KEY_ID", "s3": "AWS_ACCESS_KEY_ID", "github": "GITHUB_TOKEN", "elevenlabs": "ELEVENLABS_API_KEY",
    "runway": "RUNWAY_API_KEY", "pika": "PIKA_API_KEY", "tiktok": "TIKTOK_ACCESS_TOKEN", "instagram": "IG_ACCESS_TOKEN", "youtube": "YOUTUBE_API_KEY",
}


def _limited(df: DataFrame, most: int = 10_000) -> DataFrame:
    """Configuration for a nested loop: broadcast where it is known to be small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def stage_candidates(capability: DataFrame, terms: DataFrame, score: str, per_stage: int = 3, constraints: DataFrame | None = None, project_id: int | None = None) -> DataFrame:
    """terms (stage, term, word, want) to the best components of each stage, by score, then by the first term that finds them,
    name and id; words are looked for in names and, where there are any, in keys. The search widens from the wanted kind to all
    kinds only at the first term that has any hit, and only if none of its hits is of that kind. With a project, each term's
    best are taken first, and those that its constraints reject are no hits."""
    held = F.expr("display_name ilike concat('%', word, '%')")
    if "normalized_key" in capability.columns:
        held = held | F.expr("normalized_key ilike concat('%', word, '%')")
    hits = capability.withColumn("score", F.coalesce(F.col(score), F.lit(0))).join(_limited(terms), held).withColumn("preferred", F.col("component_kind") == F.col("want"))
    best = (F.desc("score"), F.asc("display_name"), F.asc("id"))
    if project_id is not None and constraints is not None:
        place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*best))
        hits = hits.withColumns({"_p": place("stage", "term", "preferred"), "_a": place("stage", "term")}).where(((F.col("_p") <= per_stage) & F.col("preferred")) | (F.col("_a") <= per_stage)).drop("_p", "_a")
        passing = fitting(hits.select(*capability.columns).dropDuplicates(["id"]), constraints, project_id).select("id")
        hits = hits.join(passing, "id", "left_semi")
    by_term = hits.groupBy("stage", "term").agg(F.count_if("preferred").alias("n"))
    stages = by_term.groupBy("stage").agg(F.min("term").alias("first"), F.min_by("n", "term").alias("n"))  # a row for each stage
    kept = hits.join(F.broadcast(stages), "stage").where("preferred or (term = first and n = 0)")
    kept = kept.groupBy("stage", "id", "display_name", "runtime", "score").agg(F.min("term").alias("term"))
    order = Window.partitionBy("stage").orderBy(F.desc("score"), "term", "display_name", "id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_stage).select("stage", "rank", "id", "runtime", "score")


def adjacent(stages: DataFrame, candidates: DataFrame) -> DataFrame:
    """stages (stage; a row for each stage of one proposal) with pick and runtime of the first candidate, null where there is
    none, and those of the next stage; the last stage has no next one."""
    picks = candidates.where("rank = 1").select("stage", F.col("id").alias("pick"), "runtime")
    after = Window.orderBy("stage")  # one row for each stage
    lead = lambda c: F.lead(c).over(after)
    rows = stages.select("stage").distinct().join(picks, "stage", "left")
    return rows.select("stage", "pick", "runtime", lead("stage").alias("next_stage"), lead("pick").alias("next_pick"), lead("runtime").alias("next_runtime"))


IO = "struct<kind:string,type:string,of:string>"


def pipeline(stages: DataFrame, candidates: DataFrame, interfaces: DataFrame | None = None) -> DataFrame:
    """A row for each stage: its pick, the verdict, reason and adapter hint on the step to the next stage's (unresolved,
    missing_pick where either has none; null after the last) and a note where the registry has no candidate. interfaces (id,
    output, input) has the types that components give and take."""
    rows = adjacent(stages, candidates)
    none = F.lit(None).cast(IO)
    if interfaces is None:
        rows = rows.withColumns({"src_output": none, "tgt_input": none})
    else:
        rows = rows.join(interfaces.select(F.col("id").alias("pick"), F.col("output").alias("src_output")), "pick", "left")
        rows = rows.join(interfaces.select(F.col("id").alias("next_pick"), F.col("input").alias("tgt_input")), "next_pick", "left")
    edges = compatibility(rows.select("*", F.col("runtime").alias("src_runtime"), F.col("next_runtime").alias("tgt_runtime")))
    last, missing = F.col("next_stage").isNull(), F.col("pick").isNull() | F.col("next_pick").isNull()
    of = lambda c, unknown: F.when(last, F.lit(None)).when(missing, unknown).otherwise(F.col(c))
    note = F.when(F.col("pick").isNull(), F.concat(F.lit("stage "), F.col("stage").cast("string"), F.lit(": no candidates in the registry")))
    return edges.select("stage", "pick", "next_stage", "next_pick", of("verdict", "unresolved").alias("verdict"), of("reason", "missing_pick").alias("reason"), of("adapter_hint", "").alias("adapter_hint"), note.alias("note"))


def env_hints(capability: DataFrame) -> DataFrame:
    """id and the sorted environment variables that a component likely needs."""
    named = F.array()
    for runtime, names in RUNTIME_ENV.items():
        named = F.when(F.col("runtime") == runtime, F.array(*map(F.lit, names))).otherwise(named)
    tokens = F.array_compact(F.array(*(F.when(F.contains(F.lower("normalized_key"), F.lit(t)), F.lit(v)) for t, v in TOKEN_ENV.items())))
    env = F.array_sort(F.array_union(named.cast("array<string>"), tokens))
    return capability.select("id", F.array_join(env, ",").alias("env")).where("env <> ''")


def model_hook(prompts: DataFrame, call, at_once: int) -> DataFrame:
    """id and raw_response of call(prompt); the number of partitions bounds how many calls run together."""

    def called(batches):
        for pdf in batches:
            yield pdf[["id"]].assign(raw_response=[call(p) for p in pdf["prompt"]])

    return prompts.select("id", "prompt").repartition(at_once).mapInPandas(called, "id long, raw_response string")
