"""Scorecards, their parts and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import profiles, scoring
from vitrine.plans.catalogue import Catalogue
from vitrine.plans.common import DIMENSION_SQL, cards, facts
from vitrine.sources.views import view

CATALOGUE = Catalogue()
add = CATALOGUE.add
_WITH = f"WITH {DIMENSION_SQL.strip()}"


@add("sco1_scorecard", f"{_WITH} SELECT version_id, dimension, n, raw, CAST(n > 0 AS INT) AS coverage, contradiction, CAST(round(raw * weight, 3) AS DECIMAL(18,3)) AS weighted FROM dims")
def sco1_scorecard(spark, d):
    return scoring.long_form(facts(spark, d)).select("version_id", "dimension", "n", "raw", "coverage", "contradiction", "weighted")


_CONTRA = "SELECT version_id, count(*) AS n, count(DISTINCT spdx_id) AS n_distinct, count(*) >= 2 AND count(DISTINCT spdx_id) > 1 AS contradicted FROM {evidence} WHERE evidence_type = 'license' GROUP BY version_id"


@add("sco2_contradiction", _CONTRA)
@add("agg13_disagreement", _CONTRA)
def sco2_contradiction(spark, d):
    return scoring.contradictions(view(spark, d, "evidence"), "license", "spdx_id")


@add("sco3_confidence", f"{_WITH} SELECT version_id, total_score, confidence FROM cards")
def sco3_confidence(spark, d):
    return cards(spark, d)


@add("sco4_score_links", "SELECT version_id, evidence_id, CASE evidence_type WHEN 'license' THEN 'has_identified_license' WHEN 'test_indicator' THEN 'has_tests' WHEN 'interface' THEN 'interface_surface' WHEN 'secret_indicator' THEN 'no_secret_indicators' ELSE 'has_declared_dependencies' END AS dimension FROM {evidence} WHERE evidence_type <> 'setup_py_detected' AND NOT (evidence_type = 'license' AND spdx_id = 'unknown')")
def sco4_score_links(spark, d):
    rows = view(spark, d, "evidence")
    names = F.array_compact(F.array(*(F.when(scoring.matches(x), F.lit(x.name)) for x in scoring.DEFAULT_PROFILE)))
    return rows.select("version_id", "evidence_id", F.explode(names).alias("dimension"))


_NUMBERS = "CASE dimension WHEN 'has_identified_license' THEN 1 WHEN 'has_tests' THEN 2 WHEN 'interface_surface' THEN 3 WHEN 'no_secret_indicators' THEN 4 ELSE 5 END"
_OF_TYPE = "CASE evidence_type WHEN 'license' THEN 1 WHEN 'test_indicator' THEN 2 WHEN 'interface' THEN 3 WHEN 'secret_indicator' THEN 4 ELSE 5 END"
_HASH = f"""{_WITH},
lines AS (
  SELECT version_id, -1 AS dim, '' AS id, '{scoring.profile_hash()}' AS line FROM {{capability_version}}
  UNION ALL SELECT version_id, {_NUMBERS}, '', concat_ws('|', dimension, CAST(n AS STRING), CAST(raw AS STRING), CAST(CAST(weight AS DECIMAL(4,3)) AS STRING), CAST(CAST(round(raw * weight, 3) AS DECIMAL(18,3)) AS STRING),
    CAST(CAST(n > 0 AS INT) AS STRING), CAST(contradiction AS STRING)) FROM dims
  UNION ALL SELECT version_id, {_OF_TYPE}, evidence_id, evidence_id FROM {{evidence}} WHERE evidence_type <> 'setup_py_detected' AND NOT (evidence_type = 'license' AND spdx_id = 'unknown')),
hashes AS (SELECT version_id, sha256(string_agg(line, chr(10) ORDER BY dim, id)) AS computed_hash FROM lines GROUP BY version_id)"""


def _hashes(spark, d):
    return scoring.result_hashes(view(spark, d, "capability_version"), view(spark, d, "evidence"))


@add("agg12_result_hash", f"{_HASH} SELECT version_id, computed_hash FROM hashes")
def agg12_result_hash(spark, d):
    return _hashes(spark, d)


@add("sco5_hash", f"{_HASH} SELECT version_id, computed_hash, version_id % 3 = 0 AS was_noop FROM hashes")
def sco5_hash(spark, d):
    """Scoring again: a third of the versions has a scorecard of the same evidence, a third one of other evidence, a third none."""
    hashes = _hashes(spark, d)
    prior = hashes.where("version_id % 3 <> 2").select("version_id", F.when(F.col("version_id") % 3 == 0, F.col("computed_hash")).otherwise(F.reverse("computed_hash")).alias("computed_hash"))
    return scoring.rescored(hashes, prior)


@add("src9_profile", "SELECT * FROM (VALUES ('has_identified_license', 0.20), ('has_tests', 0.20), ('interface_surface', 0.15), ('no_secret_indicators', 0.25), ('has_declared_dependencies', 0.20)) AS t(dimension, weight), (SELECT count(DISTINCT version_id) AS n_versions FROM {evidence})")
def src9_profile(spark, d):
    """The validated profile as a frame, beside the number of versions that it applies to."""
    wrong = scoring.validate_profile(scoring.DEFAULT_PROFILE)
    if wrong:
        raise ValueError("; ".join(wrong))
    rows = spark.createDataFrame([(x.name, x.weight) for x in scoring.DEFAULT_PROFILE], "dimension string, weight string")
    n = view(spark, d, "evidence").agg(F.count_distinct("version_id").alias("n_versions"))
    return rows.join(n, F.lit(True)).select("dimension", F.col("weight").cast("decimal(4,2)").alias("weight"), "n_versions")


_CONFIGS = """
SELECT path, kind, CASE WHEN faults = '' THEN name END AS name, CASE WHEN faults = '' AND kind <> 'providers' THEN k + 1 END AS version, CASE WHEN faults = '' THEN sha256(told) END AS sha256,
  CASE WHEN faults = '' THEN CASE kind WHEN 'profile' THEN 2 ELSE 1 END END AS n_items, faults
FROM (SELECT *, CASE kind WHEN 'providers' THEN NULL ELSE left(kind, 1) || CAST(k AS STRING) END AS name,
  CASE kind
    WHEN 'profile' THEN CASE f WHEN 1 THEN 'version is not a positive integer' WHEN 2 THEN 'dimension 0: unknown kind sum' WHEN 3 THEN 'dimension tests is used twice' WHEN 4 THEN 'weights don''t add up to 1' WHEN 5 THEN 'not a mapping' ELSE '' END
    WHEN 'rules' THEN CASE f WHEN 1 THEN 'unknown default MAYBE' WHEN 2 THEN 'rule 0: bad condition {"field": "fit_score", "op": "~", "value": 0.5}' WHEN 3 THEN 'rule 0: bad condition {"field": "price", "op": ">=", "value": 0.5}'
      WHEN 4 THEN 'rule 0: unknown verdict X' WHEN 5 THEN 'name is missing' ELSE '' END
    ELSE CASE f WHEN 1 THEN 'provider 0: data_retention_posture is missing' WHEN 2 THEN 'provider 0: a model has no id' WHEN 3 THEN 'providers are missing' ELSE '' END END AS faults,
  CASE kind
    WHEN 'profile' THEN '{"dimensions":[{"evidence_type":"test_indicator","kind":"count","name":"tests","normalize_cap":null,"normalize_ceiling":10,"require_field":null,"require_field_not_value":null,"weight":0.25},{"evidence_type":"license","kind":"presence","name":"licensed","normalize_cap":null,"normalize_ceiling":null,"require_field":"spdx_id","require_field_not_value":"'
      || segment || '","weight":0.75}],"name":"p' || CAST(k AS STRING) || '","version":' || CAST(k + 1 AS STRING) || '}'
    WHEN 'rules' THEN '{"default":"BUILD","name":"r' || CAST(k AS STRING) || '","rules":[{"conditions":[{"field":"fit_score","op":">=","value":0.5}],"name":"' || segment || '","verdict":"ADAPT"}],"version":' || CAST(k + 1 AS STRING) || '}'
    ELSE '[{"api_key_env":"KEY","base_url":"https://' || CAST(k AS STRING) || '","data_retention_posture":"none","models":[{"id":"m"}],"name":"' || segment || '","tier":"free"}]' END AS told
FROM (SELECT c_custkey AS k, (c_custkey // 3) % 6 AS f, c_mktsegment AS segment, 'config/' || CAST(c_custkey AS STRING) AS path, CASE c_custkey % 3 WHEN 0 THEN 'profile' WHEN 1 THEN 'rules' ELSE 'providers' END AS kind FROM {customer}))"""


@add("src9_configs", _CONFIGS)
def src9_configs(spark, d):
    """A configuration file for each customer, a profile, rules or providers in turn, most with one fault."""
    k, version, f = F.col("c_custkey").cast("string"), (F.col("c_custkey") + 1).cast("string"), F.floor(F.col("c_custkey") / 3) % 6
    kind = F.element_at(F.array(*map(F.lit, ("profile", "rules", "providers"))), (F.col("c_custkey") % 3 + 1).cast("int"))

    def quoted(wrong: int, odd: str, good):
        return F.concat(F.lit('"'), F.when(f == wrong, odd).otherwise(good), F.lit('"'))

    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    profile = text(
        '{"version": ', F.when(f == 1, "0").otherwise(version), ', "name": "p', k, '", "dimensions": [{"name": "tests", "kind": ', quoted(2, "sum", "count"),
        ', "weight": 0.25, "normalize": {"ceiling": 10}, "inputs": {"evidence_type": "test_indicator"}}, {"inputs": {"evidence_type": "license"}, "name": ', quoted(3, "tests", "licensed"),
        ', "weight": ', F.when(f == 4, "0.5").otherwise("0.75"), ', "kind": "presence", "require_field_not": {"field": "spdx_id", "value": "', F.col("c_mktsegment"), '"}}]}',
    )
    rules = text(
        '{"name": ', quoted(5, "", F.concat(F.lit("r"), k)), ', "version": ', version, ', "default": ', quoted(1, "MAYBE", "BUILD"), ', "rules": [{"name": "', F.col("c_mktsegment"), '", "verdict": ', quoted(4, "X", "ADAPT"),
        ', "conditions": [{"op": ', quoted(2, "~", ">="), ', "field": ', quoted(3, "price", "fit_score"), ', "value": 0.5}]}]}',
    )
    providers = text(
        "{", quoted(3, "vendors", "providers"), ': [{"name": "', F.col("c_mktsegment"), '", "tier": "free", "base_url": "https://', k, '", "api_key_env": "KEY", "data_retention_posture": ', quoted(1, "", "none"),
        ', "models": [{', quoted(2, "nid", "id"), ': "m"}]}]}',
    )
    content = F.when(kind == "profile", F.when(f == 5, F.left(profile, F.lit(30))).otherwise(profile)).when(kind == "rules", rules).otherwise(providers)
    return profiles.checked(view(spark, d, "customer").select(F.concat(F.lit("config/"), k).alias("path"), kind.alias("kind"), content.alias("content")))
