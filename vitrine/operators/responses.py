"""Raw model responses against their schemas: what is wrong with each, and the values of those that are right.

A schema is a list of checks in the order in which they are made; it compiles to one expression, which names the first
check that fails. Responses are parsed once, as variants, so that types are those that the model gave. Every parser gives
request_id, schema_error (null where the response is right) and its values, null where it is wrong.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import without_fence
from vitrine.operators.judgment import KINDS

#: Roles of a pipeline's stages, and lengths to which texts are cut.
ROLES = ("producer", "transformer", "sink")
RATIONALE, NAME, PURPOSE, TERMS = 280, 60, 280, 8

Checks = list[tuple[Column, Column | str]]


def of(v: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{key}", kind)


def type_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.startswith(type_of(v), F.lit("OBJECT"))


def is_list(v: Column) -> Column:
    return F.startswith(type_of(v), F.lit("ARRAY"))


def is_number(v: Column) -> Column:
    return type_of(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")


def is_score(v: Column) -> Column:
    """A number, not a text or a truth value, from 0 to 1."""
    return is_number(v) & F.coalesce(v.cast("string").cast("double").between(0, 1), F.lit(False))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def number_of(v: Column) -> Column:
    """A number that may be given as a text or a truth value; null where it is none."""
    text = stripped(v.cast("string"))
    plain = text.rlike(r"(?i)^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)$")
    return F.when(type_of(v) == "BOOLEAN", (text == "true").cast("double")).when(plain & ~type_of(v).isin("VOID"), text.try_cast("double"))


def first_error(checks: Checks) -> Column:
    """The slug of the first check (fails, slug) that fails."""
    return reduce(lambda rest, c: F.when(F.coalesce(c[0], F.lit(False)), c[1]).otherwise(rest), reversed(checks), F.lit(None).cast("string"))


def an_object(v: Column) -> Checks:
    return [(v.isNull(), "not_json"), (~is_object(v), "not_object")]


def held(name: str) -> Column:
    """A field that _parsed has taken out of a response."""
    return F.col(f"_{name}")


def held_type(name: str) -> Column:
    return F.col(f"_{name}_type")


def required(*names: str) -> Checks:
    return [(held(n).isNull(), f"missing_field: {n}") for n in names]


def loose_confidence() -> Checks:
    score = held("number")
    return [(score.isNull(), "bad_confidence"), (F.isnan(score) | ~score.between(0, 1), "confidence_out_of_range")]


def _parsed(responses: DataFrame, raw: Column, checks, values: dict[str, Column], keys=("request_id",), fields: tuple[str, ...] = (), made: dict[str, Column] | None = None) -> DataFrame:
    """fields are taken out of each response once, with their types, and made from them once, before checks and values look at
    them many times."""
    rows = responses.select(*keys, F.try_parse_json(raw).alias("v"))
    if fields:
        rows = rows.select("*", *(of(F.col("v"), n).alias(f"_{n}") for n in fields))
        rows = rows.select("*", *(type_of(held(n)).alias(f"_{n}_type") for n in fields))
        for n, c in (made or {}).items():
            rows = rows.withColumn(f"_{n}", c)
    rows = rows.withColumn("schema_error", first_error(checks(F.col("v"))))
    right = F.col("schema_error").isNull()
    return rows.select(*keys, "schema_error", *(F.when(right, c).alias(n) for n, c in values.items()))


def link_decisions(responses: DataFrame, keys=("request_id",)) -> DataFrame:
    """same, confidence and rationale of each response, which the columns keys name."""
    fields = ("same_component", "confidence", "rationale")

    def checks(v):
        return [*an_object(v), *required(*fields), (held_type("same_component") != "BOOLEAN", "bad_same_component"), *loose_confidence()]

    rationale = F.left(stripped(of(F.col("v"), "rationale", "string")), F.lit(RATIONALE))
    values = {"same": of(F.col("v"), "same_component", "boolean"), "confidence": held("number"), "rationale": rationale}
    return _parsed(responses, without_fence(F.col("raw_response")), checks, values, keys, fields, {"number": number_of(held("confidence"))})


def supersession_decisions(responses: DataFrame) -> DataFrame:
    """deprecated, confidence, successor_name (null for a blank one) and rationale of each response."""
    v, fields = F.col("v"), ("deprecated", "confidence", "successor_name", "rationale")

    def checks(v):
        named = [(~held_type("successor_name").isin("STRING", "VOID"), "bad_successor_name")]
        return [*an_object(v), *required(*fields), (held_type("deprecated") != "BOOLEAN", "bad_deprecated"), *loose_confidence(), *named]

    name = stripped(of(v, "successor_name", "string"))
    values = {"deprecated": of(v, "deprecated", "boolean"), "confidence": held("number"), "successor_name": F.when(name != "", name), "rationale": F.left(stripped(of(v, "rationale", "string")), F.lit(RATIONALE))}
    return _parsed(responses, without_fence(F.col("raw_response")), checks, values, ("request_id",), fields, {"number": number_of(held("confidence"))})


STAGE_FIELDS = ("name", "purpose", "search_terms", "role", "preferred_component_kind")


def stage_proposals(responses: DataFrame) -> DataFrame:
    """stages of each response: an array of name, purpose, search_terms, role and kind."""
    v = F.col("v")
    low = lambda s, k: stripped(F.lower(of(s, k, "string")))

    def wrong(s: Column, i: Column) -> Column:
        slug = lambda text: F.concat(F.lit("stage_"), i.cast("string"), F.lit(text))
        checks = [(~is_object(s), slug("_not_object")), *((of(s, k).isNull(), slug(f"_missing_{k}")) for k in STAGE_FIELDS)]
        checks += [(~F.coalesce(low(s, "role").isin(*ROLES), F.lit(False)), slug("_bad_role")), (~F.coalesce(low(s, "preferred_component_kind").isin(*KINDS), F.lit(False)), slug("_bad_kind"))]
        terms = of(s, "search_terms")
        return first_error([*checks, (~is_list(terms) | (F.size(terms.try_cast("array<variant>")) == 0), slug("_bad_search_terms"))])

    def checks(v):
        stages = of(v, "stages", "array<variant>")
        errors = F.filter(F.transform(stages, wrong), lambda e: e.isNotNull())
        return [(v.isNull(), "not_json"), (~is_object(v) | of(v, "stages").isNull(), "missing_stages_field"), (~is_list(of(v, "stages")) | (F.size(stages) == 0), "stages_not_a_nonempty_list"), (F.size(errors) > 0, F.get(errors, F.lit(0)))]

    def stage(s: Column) -> Column:
        cut = lambda k, n: F.left(stripped(of(s, k, "string")), F.lit(n)).alias(k)
        terms = F.filter(F.transform(of(s, "search_terms", "array<variant>"), lambda t: stripped(t.cast("string"))), lambda t: t != "")
        return F.struct(cut("name", NAME), cut("purpose", PURPOSE), F.slice(terms, 1, TERMS).alias("search_terms"), low(s, "role").alias("role"), low(s, "preferred_component_kind").alias("kind"))

    return _parsed(responses, without_fence(F.col("raw_response")), checks, {"stages": F.transform(of(v, "stages", "array<variant>"), stage)})


def evidence_judgments(responses: DataFrame) -> DataFrame:
    """verdict, criteria_scores (a map), self_confidence and evidence_refs (ids in lower-case hex without hyphens)."""
    v, fields = F.col("v"), ("verdict", "criteria_scores", "self_confidence", "evidence_refs")
    plain = lambda ref: F.lower(F.replace(F.regexp_replace(F.regexp_replace(ref, "urn:|uuid:", ""), r"^[{}]+|[{}]+$", ""), F.lit("-"), F.lit("")))

    def checks(v):
        each, listed = F.map_values(held("scores")), held("listed")
        return [
            *an_object(v), *required(*fields),
            ((held_type("verdict") != "STRING") | (stripped(held("verdict").cast("string")) == ""), "bad_verdict"),
            (~F.startswith(held_type("criteria_scores"), F.lit("OBJECT")) | (F.size(each) == 0), "bad_criteria_scores"), (F.exists(each, lambda s: ~is_score(s)), "criteria_score_out_of_range"),
            (~is_score(held("self_confidence")), "bad_self_confidence"), (~F.startswith(held_type("evidence_refs"), F.lit("ARRAY")), "evidence_refs_not_a_list"),
            (F.exists(listed, lambda r: type_of(r) != "STRING"), "evidence_ref_not_a_string"), (F.exists(held("refs"), lambda r: ~r.rlike("^[0-9a-f]{32}$")), "evidence_ref_not_a_uuid"),
        ]

    made = {"scores": of(v, "criteria_scores", "map<string,variant>"), "listed": of(v, "evidence_refs", "array<variant>"), "refs": F.transform(held("listed"), lambda r: plain(r.cast("string")))}
    scores = F.transform_values(held("scores"), lambda _, s: s.cast("string").cast("double"))
    values = {"verdict": of(v, "verdict", "string"), "criteria_scores": scores, "self_confidence": of(v, "self_confidence", "double"), "evidence_refs": held("refs")}
    return _parsed(responses, F.col("raw_response"), checks, values, ("request_id",), fields, made)


def reference_outcomes(judgments: DataFrame, evidence: DataFrame) -> DataFrame:
    """request_id, n_refs, n_found and grounded of right judgments: whether each evidence it names is there. evidence has a
    column ref, once for each. Distinct references are looked up, so a popular one is asked for once."""
    refs = judgments.where("schema_error is null").select("request_id", F.explode_outer("evidence_refs").alias("ref")).distinct()
    known = refs.select("ref").where("ref is not null").distinct().join(evidence.select("ref"), "ref", "left_semi").withColumn("_found", F.lit(True))
    told = refs.join(known, "ref", "left").groupBy("request_id").agg(F.count("ref").alias("n_refs"), F.count("_found").alias("n_found"))
    return told.withColumn("grounded", F.col("n_refs") == F.col("n_found"))
