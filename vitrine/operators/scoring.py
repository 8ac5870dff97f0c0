"""Evidence scorecards and component health scores for all versions or components at once."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.digests import sha256_of_lines

DEC = "decimal(18,3)"


@dataclass(frozen=True)
class Dimension:
    """One dimension of a scoring profile. Evidence whose field has the value field_not doesn't count, and evidence that
    counts contradicts itself where it disagrees on the field."""

    name: str
    weight: str
    kind: str  # presence, count or absence
    evidence_type: str
    bound: int = 1  # ceiling of a count, cap of an absence
    field: str | None = None
    field_not: str | None = None


#: Fixed values of the default profile.
DEFAULT_PROFILE = (
    Dimension("has_identified_license", "0.20", "presence", "license", field="spdx_id", field_not="unknown"),
    Dimension("has_tests", "0.20", "count", "test_indicator", 10),
    Dimension("interface_surface", "0.15", "count", "interface", 20),
    Dimension("no_secret_indicators", "0.25", "absence", "secret_indicator", 5),
    Dimension("has_declared_dependencies", "0.20", "presence", "dependency"),
)


def validate_profile(profile) -> list[str]:
    """What is wrong with a profile; nothing if it is usable."""
    found = []
    if abs(sum(float(d.weight) for d in profile) - 1) > 1e-6:
        found.append("weights don't add up to 1")
    if len({d.name for d in profile}) != len(profile):
        found.append("a name is used twice")
    found += [f"{d.name}: unknown kind {d.kind}" for d in profile if d.kind not in ("presence", "count", "absence")]
    return found + [f"{d.name}: bound below 1" for d in profile if d.bound < 1]


def profile_hash(profile=DEFAULT_PROFILE) -> str:
    """SHA-256 of a profile's content, a line for each dimension."""
    lines = ("|".join(str(x) for x in (d.name, d.weight, d.kind, d.evidence_type, d.bound, d.field or "", d.field_not or "")) for d in profile)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def register_profile(registered: DataFrame, name: str, version: int, profile=DEFAULT_PROFILE) -> DataFrame:
    """registered (name, version, profile_hash) with the profile's row. A registered version can't change: another content
    under its number raises, so the number has to rise with the content."""
    if version < 1:
        raise ValueError(f"profile {name}: version {version} is not positive")
    told = profile_hash(profile)
    there = [r["profile_hash"] for r in registered.where((F.col("name") == name) & (F.col("version") == version)).select("profile_hash").take(2)]
    if any(h != told for h in there):
        raise ValueError(f"profile {name} version {version} is registered with another content")
    if there:
        return registered
    return registered.unionByName(registered.sparkSession.createDataFrame([(name, version, told)], "name string, version int, profile_hash string"))


def matches(d: Dimension) -> Column:
    """True for evidence that a dimension counts; a missing field passes the filter."""
    on = F.col("evidence_type") == d.evidence_type
    return on if d.field is None else on & ~F.col(d.field).eqNullSafe(F.lit(d.field_not))


def _differ(d: Dimension) -> Column:
    """True where counted evidence disagrees on the field; null is a value. Hashes of the values are compared: two longs for
    each version, which Spark combines without sorting, and no set of values."""
    if d.field is None:
        return F.lit(False)
    value = F.when(matches(d), F.xxhash64(d.field))
    return F.coalesce(F.min(value) != F.max(value), F.lit(False))


def dimension_aggregates(profile=DEFAULT_PROFILE) -> list[Column]:
    """For each dimension its count, under its name, and whether its evidence disagrees, under its name with _differ."""
    return [F.count_if(matches(d)).alias(d.name) for d in profile] + [_differ(d).alias(f"{d.name}_differ") for d in profile]


def version_facts(evidence: DataFrame, revision: DataFrame, binding: DataFrame | None = None, versions: DataFrame | None = None, profile=DEFAULT_PROFILE, more=()) -> DataFrame:
    """One row for each version with all that scores, gates, guards and pins look at, from one pass and one shuffle; more are
    further aggregates.

    A version is bound to the revisions of its evidence and of binding; versions without any evidence come from versions.
    The sets of licence and pattern names are as small as their vocabularies."""
    rows = evidence.select("version_id", "revision_id", "evidence_type", "spdx_id", "name")
    for other in (binding, versions):
        if other is not None:
            rows = rows.unionByName(other.select(*(c for c in ("version_id", "revision_id") if c in other.columns)), allowMissingColumns=True)
    rows = rows.join(revision.select("revision_id", "asset_id", "identified_at", "content_hash"), "revision_id", "left")
    of_type = lambda t: F.col("evidence_type") == t
    names = lambda t, c: F.array_sort(F.collect_set(F.when(of_type(t), F.col(c))))
    bound = F.when(F.col("identified_at").isNotNull(), F.struct("identified_at", "revision_id", "asset_id"))
    facts = rows.groupBy("version_id").agg(
        *dimension_aggregates(profile), names("license", "spdx_id").alias("spdx_ids"), names("secret_indicator", "name").alias("secret_names"), F.count_if(of_type("license")).alias("n_licenses"),
        F.count_if(of_type("secret_indicator")).alias("n_secrets"), F.count_if(of_type("setup_py_detected")).alias("n_setup_py"), F.count_if(of_type("interface")).alias("n_interfaces"),
        (F.count("revision_id") > 0).alias("has_binding"), (F.count("content_hash") > 0).alias("has_hash"), F.max(bound).alias("bound"), *more,
    )
    return facts.withColumns({"bound_at": F.col("bound.identified_at"), "asset_id": F.col("bound.asset_id"), "pinned_revision": F.col("bound.revision_id")}).drop("bound")


def dimension_rows(profile=DEFAULT_PROFILE) -> list[Column]:
    """A struct for each dimension over the dimension aggregates."""
    rows = []
    for d in profile:
        n = F.coalesce(F.col(d.name), F.lit(0))
        share = F.least(n, F.lit(d.bound)).cast("decimal(10,0)") / F.lit(d.bound).cast("decimal(10,0)")
        raw = (1 - share if d.kind == "absence" else share).cast(DEC)
        weight = F.lit(d.weight).cast("decimal(4,3)")
        differ = F.coalesce(F.col(f"{d.name}_differ"), F.lit(False)).cast("int")
        rows.append(F.struct(F.lit(d.name).alias("dimension"), n.alias("n"), raw.alias("raw"), (n > 0).cast("int").alias("coverage"), differ.alias("contradiction"),
                             weight.alias("weight"), F.round(raw * weight, 3).cast(DEC).alias("weighted")))
    return rows


def dimension_results(versions: DataFrame, evidence: DataFrame, profile=DEFAULT_PROFILE) -> DataFrame:
    """version_id, dimension, n, raw, coverage, contradiction, weight, weighted in long form, for every version."""
    wide = versions.select("version_id").join(evidence.groupBy("version_id").agg(*dimension_aggregates(profile)), "version_id", "left")
    return long_form(wide, profile)


def long_form(facts: DataFrame, profile=DEFAULT_PROFILE) -> DataFrame:
    return facts.select("version_id", F.explode(F.array(*dimension_rows(profile))).alias("d")).select("version_id", "d.*")


def card_columns(profile=DEFAULT_PROFILE) -> dict[str, Column]:
    """total_score and confidence over the dimension aggregates: confidence is the covered weight, less the share of
    covered dimensions that contradict themselves. In thousandths, as integers, halves up."""
    rows = dimension_rows(profile)
    total = reduce(lambda a, b: a + b, [x["weighted"] for x in rows]).cast(DEC)
    covered = reduce(lambda a, b: a + b, [x["coverage"] for x in rows])
    differ = reduce(lambda a, b: a + b, [x["coverage"] * x["contradiction"] for x in rows])
    weight = reduce(lambda a, b: a + b, [x["coverage"] * F.lit(round(float(d.weight) * 1000)) for d, x in zip(profile, rows)])
    twice = 2 * weight * (covered - differ) + covered
    thousandths = F.when(covered > 0, ((twice - twice % (2 * covered)) / (2 * covered)).cast("long")).otherwise(F.lit(0))
    return {"total_score": total, "confidence": (thousandths.cast("decimal(14,0)") * F.lit("0.001").cast("decimal(4,3)")).cast(DEC)}


def scorecards(facts: DataFrame, profile=DEFAULT_PROFILE) -> DataFrame:
    """version_id, total_score and confidence of version_facts (or of dimension aggregates by version)."""
    return facts.select("version_id", *(c.alias(n) for n, c in card_columns(profile).items()))


def contradictions(evidence: DataFrame, evidence_type: str, field: str) -> DataFrame:
    """version_id, n, n_distinct and contradicted: two items or more that disagree on a field; null is a value."""
    rows = evidence.where(F.col("evidence_type") == evidence_type)
    told = rows.groupBy("version_id").agg(F.count("*").alias("n"), F.count_distinct(F.struct(field)).alias("n_distinct"))
    return told.withColumn("contradicted", (F.col("n") >= 2) & (F.col("n_distinct") > 1))


def result_hashes(versions: DataFrame, evidence: DataFrame, profile=DEFAULT_PROFILE) -> DataFrame:
    """version_id and a SHA-256 over the profile's hash and, dimension by dimension, the result and the sorted ids of the
    evidence that counts: other evidence changes it, the order of rows doesn't. The lines stream in order, so a version's
    evidence isn't gathered."""
    head = versions.select("version_id", F.struct(F.lit(-1).alias("dim"), F.lit("").alias("id")).alias("place"), F.lit(profile_hash(profile)).alias("line"))
    number = F.array_position(F.array(*(F.lit(d.name) for d in profile)), F.col("dimension")).cast("int")
    text = F.concat_ws("|", "dimension", *(F.col(c).cast("string") for c in ("n", "raw", "weight", "weighted", "coverage", "contradiction")))
    results = dimension_results(versions, evidence, profile).select("version_id", F.struct(number.alias("dim"), F.lit("").alias("id")).alias("place"), text.alias("line"))
    counted = F.array_compact(F.array(*(F.when(matches(d), F.lit(i + 1)) for i, d in enumerate(profile))))
    ids = evidence.select("version_id", "evidence_id", F.explode(counted).alias("dim"))
    ids = ids.select("version_id", F.struct("dim", F.col("evidence_id").alias("id")).alias("place"), F.col("evidence_id").alias("line"))
    lines = head.unionByName(results).unionByName(ids).withColumn("line", F.encode("line", "utf-8"))
    return sha256_of_lines(lines, "version_id", "n_lines", "computed_hash", b"\n").select("version_id", "computed_hash")


def rescored(hashes: DataFrame, prior: DataFrame) -> DataFrame:
    """version_id, computed_hash and was_noop: true where the prior scorecard (version_id, computed_hash) has the same hash,
    so nothing has to be written."""
    old = prior.select("version_id", F.col("computed_hash").alias("_old"))
    return hashes.join(old, "version_id", "left").select("version_id", "computed_hash", F.coalesce(F.col("_old") == F.col("computed_hash"), F.lit(False)).alias("was_noop"))


# ---- health of components ----


def _clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


#: Metadata whose presence makes a component complete; four of them are enough.
COMPLETE_FIELDS = ("gemini_description", "description", "content_hash", "topics", "language", "html_url", "seed_note")


def health_dimensions() -> dict[str, tuple[Column, Column]]:
    """raw and has_evidence of each health dimension, over capability columns."""
    known = lambda *cols: reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in cols])
    yes = F.lit(True)
    stars = F.col("stars")
    popularity = F.when(stars.isNull(), 0.5).when(stars <= 0, 0.0).otherwise(_clip(F.log10(stars + 1) / 4.0))
    issues = F.when(F.col("open_issues") > 0, 0.5).otherwise(0.0) + F.when(F.col("forks") > 0, 0.5).otherwise(0.0)
    fields = [(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").cast("int") for c in COMPLETE_FIELDS]
    filled = reduce(lambda a, b: a + b, fields)
    return {
        "freshness": (F.when(F.col("days_old").isNull(), 0.5).otherwise(_clip(1 - F.col("days_old") / 730.0)), known("days_old")),
        "popularity": (popularity, known("stars")),
        "activity": (F.when(known("open_issues", "forks"), issues).otherwise(0.5), known("open_issues", "forks")),
        "license_clarity": (F.when(F.col("license_spdx").isNotNull(), 1.0).otherwise(0.3), yes),
        "description_quality": (F.when(F.col("gemini_description").isNotNull(), 1.0).when(known("description", "seed_note"), 0.6).otherwise(0.0), yes),
        "ecosystem_bonus": (F.when(F.col("ecosystem").isin("pypi", "npm", "cargo", "gem"), 1.0).when(F.col("ecosystem") == "source", 0.5).otherwise(0.3), yes),
        "completeness": (_clip(filled / 4.0), filled > 0),
        "transport_clarity": (F.when(F.lower("transport").isin("stdio", "sse", "http"), 1.0).otherwise(0.3), yes),
    }


#: Weight of each dimension in each kind's profile.
HEALTH_PROFILES = {
    "repo": {"freshness": 0.30, "popularity": 0.30, "activity": 0.10, "license_clarity": 0.15, "description_quality": 0.15},
    "library": {"license_clarity": 0.35, "description_quality": 0.40, "ecosystem_bonus": 0.25},
    "skill": {"completeness": 0.50, "description_quality": 0.40, "license_clarity": 0.10},
    "mcp_tool": {"transport_clarity": 0.60, "description_quality": 0.40},
    "agent": {"description_quality": 1.0},
    "workflow_template": {"completeness": 1.0},
}


def health_long(capability: DataFrame, more=()) -> DataFrame:
    """capability_id, component_kind, dimension, raw, weight, weighted, has_evidence; more are dimensions of plug-ins."""
    dims = health_dimensions() | {d.name: (d.raw.cast("double"), d.has_evidence) for d in more}
    by_kind = F.array().cast("array<struct<dimension:string,raw:double,weight:double,has_evidence:boolean>>")
    for kind, weights in HEALTH_PROFILES.items():
        weights = weights | {d.name: d.weights[kind] for d in more if kind in d.weights}
        rows = [F.struct(F.lit(k).alias("dimension"), dims[k][0].alias("raw"), F.lit(w).alias("weight"), dims[k][1].alias("has_evidence")) for k, w in weights.items()]
        by_kind = F.when(F.col("component_kind") == kind, F.array(*rows)).otherwise(by_kind)
    rows = capability.select(F.col("id").alias("capability_id"), "component_kind", F.explode(by_kind).alias("d")).select("capability_id", "component_kind", "d.*")
    return rows.withColumn("weighted", F.round(F.col("raw") * F.col("weight"), 4).cast("decimal(18,4)"))


def health_scores(capability: DataFrame, more=()) -> DataFrame:
    """capability_id, profile_name, total (1 at most), confidence (the share of dimensions with real evidence)."""
    long = health_long(capability, more)
    out = long.groupBy("capability_id", "component_kind").agg(
        F.least(F.lit(1.0), F.round(F.sum("weighted"), 3).cast("double")).alias("total"), F.round(F.avg(F.col("has_evidence").cast("int")), 3).alias("confidence")
    )
    return out.select("capability_id", F.concat("component_kind", F.lit("_health")).alias("profile_name"), "total", "confidence")


def score_changes(new: DataFrame, old: DataFrame) -> DataFrame:
    """new with outcome new, updated or unchanged against the scores of the run before."""
    o = old.select("capability_id", F.col("total").alias("_t"), F.col("confidence").alias("_c"), F.lit(True).alias("_seen"))
    same = F.col("total").eqNullSafe(F.col("_t")) & F.col("confidence").eqNullSafe(F.col("_c"))
    outcome = F.when(F.col("_seen").isNull(), "new").when(same, "unchanged").otherwise("updated")
    return new.join(o, "capability_id", "left").withColumn("outcome", outcome).drop("_t", "_c", "_seen")
