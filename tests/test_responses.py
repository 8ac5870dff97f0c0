"""First failures of raw responses, one branch after the other, and the values of right ones."""

import json

import pytest
from pyspark.sql import functions as F

from vitrine.operators import responses as rs

ID = "6f1c1f0e-5f0e-4d57-9f3e-0a4f7a1c2b3d"
LINK = {"same_component": True, "confidence": 0.9, "rationale": " r "}
GONE = {"deprecated": True, "confidence": 0.9, "successor_name": " next ", "rationale": "r"}
JUDGED = {"verdict": "fine", "criteria_scores": {"a": 1, "b": 0.5}, "self_confidence": 0.7, "evidence_refs": [ID]}
STAGE = {"name": "n", "purpose": "p", "search_terms": ["x", " ", 2], "role": " SINK", "preferred_component_kind": "Library"}


def but(base, drop=(), **new):
    return json.dumps({k: v for k, v in (base | new).items() if k not in drop})


def stages(*s):
    return json.dumps({"stages": list(s)})


COMMON = [("no", "not_json"), ("", "not_json"), (None, "not_json"), ("[1]", "not_object"), ("null", "not_object"), ('"x"', "not_object")]
LINKS = COMMON + [
    (but(LINK), None), ("```json\n" + but(LINK) + "\n```", None), (" " + but(LINK, confidence="0.5 ") + " ", None), (but(LINK, confidence=True), None), (but(LINK, rationale=None), None), (but(LINK, rationale=3), None),
    *((but(LINK, drop=[k]), f"missing_field: {k}") for k in LINK), (but(LINK, drop=list(LINK)), "missing_field: same_component"), (but(LINK, same_component="true"), "bad_same_component"), (but(LINK, same_component=1), "bad_same_component"), (but(LINK, same_component=None), "bad_same_component"),
    (but(LINK, confidence="high"), "bad_confidence"), (but(LINK, confidence=None), "bad_confidence"), (but(LINK, confidence=[1]), "bad_confidence"), (but(LINK, confidence={}), "bad_confidence"), (but(LINK, confidence="1d"), "bad_confidence"), (but(LINK, confidence=1.01), "confidence_out_of_range"), (but(LINK, confidence=-1), "confidence_out_of_range"),
    (but(LINK, confidence="nan"), "confidence_out_of_range"), (but(LINK, same_component=0, confidence=7), "bad_same_component"),
]
SUPERSEDED = COMMON + [
    (but(GONE), None), (but(GONE, successor_name=None), None), (but(GONE, successor_name="  "), None), *((but(GONE, drop=[k]), f"missing_field: {k}") for k in GONE), (but(GONE, deprecated="no"), "bad_deprecated"), (but(GONE, confidence="x"), "bad_confidence"),
    (but(GONE, confidence=2), "confidence_out_of_range"), (but(GONE, successor_name=5), "bad_successor_name"), (but(GONE, successor_name=["a"]), "bad_successor_name"), (but(GONE, successor_name=5, confidence=2), "confidence_out_of_range"),
]
EVIDENCE = COMMON + [
    (but(JUDGED), None), (but(JUDGED, evidence_refs=[]), None), (but(JUDGED, evidence_refs=["{" + ID.upper() + "}", "urn:uuid:" + ID, ID.replace("-", "")]), None), *((but(JUDGED, drop=[k]), f"missing_field: {k}") for k in JUDGED),
    (but(JUDGED, verdict=" \n"), "bad_verdict"), (but(JUDGED, verdict=1), "bad_verdict"), (but(JUDGED, verdict=None), "bad_verdict"), (but(JUDGED, criteria_scores={}), "bad_criteria_scores"), (but(JUDGED, criteria_scores=[1]), "bad_criteria_scores"), (but(JUDGED, criteria_scores=None), "bad_criteria_scores"),
    *((but(JUDGED, criteria_scores={"a": 0.1, "b": x}), "criteria_score_out_of_range") for x in (1.5, -0.1, "0.5", True, None, [0.5])), *((but(JUDGED, self_confidence=x), "bad_self_confidence") for x in (1.5, "0.8", True, None)),
    (but(JUDGED, evidence_refs="x"), "evidence_refs_not_a_list"), (but(JUDGED, evidence_refs=None), "evidence_refs_not_a_list"), (but(JUDGED, evidence_refs=[ID, 3]), "evidence_ref_not_a_string"), (but(JUDGED, evidence_refs=[None]), "evidence_ref_not_a_string"), (but(JUDGED, evidence_refs=[ID, "e1"]), "evidence_ref_not_a_uuid"),
]
PROPOSED = [(r, "missing_stages_field" if e == "not_object" else e) for r, e in COMMON] + [
    (stages(STAGE), None), (stages(STAGE, STAGE), None), ("{}", "missing_stages_field"), ('{"stages": 3}', "stages_not_a_nonempty_list"), ('{"stages": []}', "stages_not_a_nonempty_list"), ('{"stages": null}', "stages_not_a_nonempty_list"), (stages(STAGE, 4), "stage_1_not_object"), (stages(None, 4), "stage_0_not_object"),
    *((stages(STAGE, {k: v for k, v in STAGE.items() if k != f}), f"stage_1_missing_{f}") for f in STAGE), (stages(STAGE | {"role": "pump"}), "stage_0_bad_role"), (stages(STAGE | {"role": None}), "stage_0_bad_role"), (stages(STAGE | {"preferred_component_kind": "robot"}), "stage_0_bad_kind"),
    (stages(STAGE | {"search_terms": []}), "stage_0_bad_search_terms"), (stages(STAGE | {"search_terms": "x"}), "stage_0_bad_search_terms"), (stages(STAGE | {"role": "x", "search_terms": []}), "stage_0_bad_role"),
]


@pytest.mark.parametrize("parser,cases", [("link_decisions", LINKS), ("supersession_decisions", SUPERSEDED), ("evidence_judgments", EVIDENCE), ("stage_proposals", PROPOSED)])
def test_first_failures(spark, parser, cases):
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(cases)], "request_id int, raw_response string")
    got = {r["request_id"]: r["schema_error"] for r in getattr(rs, parser)(df).collect()}
    assert [(raw, got[i]) for i, (raw, _) in enumerate(cases)] == cases


def test_values(spark):
    df = lambda *raw: spark.createDataFrame(list(enumerate(raw)), "request_id int, raw_response string")
    link = rs.link_decisions(df(but(LINK, rationale=" " + "x" * 400), but(LINK, same_component=False, confidence=" 1e-1"))).orderBy("request_id").collect()
    assert [(r["same"], r["confidence"], len(r["rationale"])) for r in link] == [(True, 0.9, 280), (False, 0.1, 1)]
    gone = rs.supersession_decisions(df(but(GONE), but(GONE, successor_name=" "))).orderBy("request_id").collect()
    assert [(r["deprecated"], r["successor_name"]) for r in gone] == [(True, "next"), (True, None)]
    stage = rs.stage_proposals(df(stages(STAGE))).first()["stages"][0]
    assert (stage["search_terms"], stage["role"], stage["kind"]) == (["x", "2"], "sink", "library")
    judged = rs.evidence_judgments(df(but(JUDGED, evidence_refs=[ID.upper(), ID]), but(JUDGED, evidence_refs=[]), but(JUDGED, evidence_refs=["0" * 32]), "no"))
    assert judged.where("request_id = 0").first()["criteria_scores"] == {"a": 1.0, "b": 0.5}
    found = rs.reference_outcomes(judged, spark.createDataFrame([(ID.replace("-", ""),)], "ref string"))
    assert sorted(map(tuple, found.select("request_id", F.col("n_refs"), "n_found", "grounded").collect())) == [(0, 1, 1, True), (1, 0, 0, True), (2, 1, 0, False)]
