"""Model judgments as batches: prompts, strict validation of responses, and what follows from them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import without_fence
from vitrine.operators.digests import sha256_of_lines

KINDS = ("repo", "library", "skill", "mcp_tool", "agent", "workflow_template")
APPLY, LINK = 0.80, 0.75


def prompts(capability: DataFrame) -> DataFrame:
    """id, prompt and its SHA-256; a field that is null has no line."""
    line = lambda k: F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}: "), F.col(k).cast("string")))
    text = F.concat_ws("\n", F.lit("Classify this component."), *(line(k) for k in ("normalized_key", "description", "topics", "stars")))
    return capability.select("id", text.alias("prompt"), F.sha2(text, 256).alias("prompt_hash"))


LINK_TASK = "Do these two entries stand for the same component? Answer with same, confidence and rationale."
SUPERSESSION_TASK = "Is this component retired, and what follows it? Answer with deprecated, confidence, successor and rationale."
_NULLS = {"ignoreNullFields": "false"}


def _summary(length: int) -> list[Column]:
    described = F.left(F.coalesce("gemini_description", "description"), F.lit(length))
    return [F.col("normalized_key").alias("key"), F.col("display_name"), described.alias("description")]


def enrichment_prompts(capability: DataFrame) -> DataFrame:
    """id, prompt and its hash: what is known of a component, a line for each field that isn't null."""
    fields = {"normalized_key": F.col("normalized_key"), "display_name": F.col("display_name"), "component_kind": F.col("component_kind"), "existing_description": F.left("description", F.lit(400)), "topics": F.col("topics")}
    text = F.concat_ws("\n", *(F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), c)) for k, c in fields.items()))
    return capability.select("id", text.alias("prompt"), F.sha2(text, 256).alias("prompt_hash"))


def supersession_prompts(capability: DataFrame) -> DataFrame:
    """id, prompt (JSON) and its hash."""
    text = F.to_json(F.struct(F.lit(SUPERSESSION_TASK).alias("task"), *_summary(800), F.col("topics")), _NULLS)
    return capability.select("id", text.alias("prompt"), F.sha2(text, 256).alias("prompt_hash"))


def with_link_text(capability: DataFrame) -> DataFrame:
    """capability with told, what a link prompt tells of a component, as JSON made once for each component."""
    key, name, described = _summary(400)
    return capability.withColumn("told", F.to_json(F.struct(key, name, F.col("component_kind"), described), _NULLS))


def link_prompts_of(pairs: DataFrame) -> DataFrame:
    """pairs (library_id, repo_id, library_told, repo_told) with prompt (JSON) and its hash."""
    text = F.concat(F.lit('{"task":' + json.dumps(LINK_TASK) + ',"a":'), "library_told", F.lit(',"b":'), "repo_told", F.lit("}"))
    return pairs.select("library_id", "repo_id", text.alias("prompt"), F.sha2(text, 256).alias("prompt_hash"))


def link_prompts(pairs: DataFrame, capability: DataFrame) -> DataFrame:
    """pairs (library_id, repo_id) with prompt (JSON) and its hash."""
    side = with_link_text(capability).select("id", "told")
    return link_prompts_of(pairs.join(side.toDF("library_id", "library_told"), "library_id").join(side.toDF("repo_id", "repo_told"), "repo_id"))


def evidence_prompts(evidence: DataFrame) -> DataFrame:
    """version_id, the number of lines and the hash of a version's prompt: a heading, then a line for each piece of evidence
    by its id. Lines stream in order, so a version's evidence isn't gathered."""
    head = F.concat(F.lit("Summarise version "), F.col("version_id").cast("string"), F.lit(" from this evidence:"))
    heads = evidence.select("version_id").distinct().select("version_id", F.struct(F.lit(0).alias("part"), F.lit("").alias("id")).alias("place"), head.alias("line"))
    line = F.concat(F.lit("- ["), "evidence_id", F.lit("] "), "evidence_type", F.lit(": "), "name")
    rows = evidence.select("version_id", F.struct(F.lit(1).alias("part"), F.col("evidence_id").alias("id")).alias("place"), line.alias("line"))
    lines = heads.unionByName(rows).withColumn("line", F.encode("line", "utf-8"))
    return sha256_of_lines(lines, "version_id", "n_lines", "prompt_hash", b"\n")


def conversation_prompts(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and the hash of its turns, in order, as role: text lines."""
    line = F.encode(F.concat_ws(": ", "role", "text"), "utf-8")
    placed = turns.select("conv_id", line.alias("line"), F.struct("turn", line.alias("line")).alias("place"))
    return sha256_of_lines(placed, "conv_id", "n_turns", "prompt_hash", b"\n")


def classification_error(raw: Column) -> Column:
    """The first thing wrong with a classification response; null if it is right. Types are strict: a string is no score."""
    v = F.try_parse_json(without_fence(raw))
    kind, score = F.try_variant_get(v, "$.component_kind", "string"), F.try_variant_get(v, "$.confidence", "double")
    of = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return (
        F.when(v.isNull(), "not_json")
        .when(~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), "not_object")
        .when(F.try_variant_get(v, "$.component_kind", "variant").isNull(), "missing_component_kind")
        .when(of("$.component_kind") != "STRING", "component_kind_type")
        .when(~kind.isin(*KINDS), "component_kind_domain")
        .when(F.try_variant_get(v, "$.confidence", "variant").isNull(), "missing_confidence")
        .when(~of("$.confidence").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "confidence_type")
        .when((score < 0) | (score > 1), "confidence_range")
    )


def classifications(responses: DataFrame) -> DataFrame:
    """request_id, schema_valid, schema_error, component_kind and confidence of raw responses."""
    rows = responses.withColumn("schema_error", classification_error(F.col("raw_response"))).withColumn("_v", F.try_parse_json(without_fence(F.col("raw_response"))))
    ok = F.col("schema_error").isNull()
    kind, score = F.try_variant_get("_v", "$.component_kind", "string"), F.try_variant_get("_v", "$.confidence", "double")
    return rows.select("request_id", ok.alias("schema_valid"), "schema_error", F.when(ok, kind).alias("component_kind"), F.when(ok, score).alias("confidence"))


def error_class(error: Column) -> Column:
    """Whether a failed judgment may be tried again, was bad input, or breaks a rule."""
    return F.when(error.isNull(), F.lit(None)).when(error.isin("not_json", "not_object"), "transient").when(error.endswith("_domain"), "policy").otherwise("input")


def applied(classified: DataFrame, capability: DataFrame, threshold: float = APPLY) -> DataFrame:
    """Valid classifications with the prior kind and an outcome: applied, unchanged, or recorded for low confidence."""
    rows = classified.where("schema_valid").join(capability.select(F.col("id").alias("request_id"), F.col("component_kind").alias("prior_kind")), "request_id")
    outcome = F.when(F.col("confidence") < threshold, "recorded").when(F.col("component_kind") == F.col("prior_kind"), "unchanged").otherwise("applied")
    return rows.withColumn("outcome", outcome).select("request_id", "prior_kind", "component_kind", "outcome")


def link_rows(decisions: DataFrame, threshold: float = LINK) -> DataFrame:
    """decisions (a, b, same, confidence, rationale) as stored links: a negative answer keeps the kind, with its confidence
    turned around and a marked rationale; a weak positive one is suppressed."""
    outcome = F.when(~F.col("same"), "negative").when(F.col("confidence") >= threshold, "linked").otherwise("suppressed")
    stored = F.when(F.col("same"), F.col("confidence")).otherwise(F.round(1 - F.col("confidence"), 3))
    rationale = F.when(F.col("same"), F.col("rationale")).otherwise(F.concat(F.lit("NOT_SAME: "), "rationale"))
    return decisions.select("a", "b", outcome.alias("outcome"), stored.alias("confidence"), rationale.alias("rationale"))


def supersession_rows(decisions: DataFrame, successors: DataFrame, threshold: float = LINK) -> DataFrame:
    """decisions (ref, deprecated, confidence) with deprecate (patch the metadata) and the successor to link, if it resolves."""
    rows = decisions.join(successors, "ref", "left")
    on = F.col("deprecated") & (F.col("confidence") >= threshold)
    return rows.select("ref", on.alias("deprecate"), F.when(on, F.col("successor_id")).alias("successor_id"))
