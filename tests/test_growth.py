"""Rows and plans of steps that many components with one name, key or requirement go through."""

import pytest

from vitrine.operators import registry


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_not_broadcast_for_hashes(spark, sf):
    """Pairs as a file are few bytes and very many rows."""
    from vitrine.plans.policy import fit4_hash

    plan = optimized(fit4_hash(spark, sf))
    assert plan.count("rightHint=(strategy=merge)") >= 3


def test_members_of_a_hot_name_stand_in_few_blocks(spark):
    """However small a block and however large a name, a member's rows are bounded, and they are not broadcast."""
    rows = [(i, "pypi:hot", "library") for i in range(500)] + [(1000 + i, f"source:github:x{i}/hot", "repo") for i in range(500)]
    cap = spark.createDataFrame(rows, "id long, normalized_key string, component_kind string")
    members = registry._tailed(cap)
    placed = registry._in_blocks(members.join(registry._cuts(members, 1), "tail"), "library")
    assert placed.count() == 500 * registry.MOST_BLOCKS
    pairs, _ = registry.new_link_candidates(cap, block=1)
    assert "BroadcastExchange" not in executed(pairs).split("Generate explode")[0] and "SortMergeJoin" in executed(pairs)
    assert pairs.distinct().count() == pairs.count() == 250_000


def test_successors_of_a_key_with_many_components(spark):
    """A name meets one component of a key, not all of them."""
    cap = spark.createDataFrame([(i, "npm:hot") for i in range(9, 3000)] + [(4000, "pypi:cold"), (7, "npm:cold")], "id long, normalized_key string")
    names = spark.createDataFrame([(1, "Hot"), (2, "cold"), (3, "none")], "ref long, name string")
    found = registry.resolve_successors(names, cap)
    assert sorted(map(tuple, found.collect())) == [(1, 9), (2, 4000)]
    assert optimized(found).count("Aggregate [normalized_key") == 1


def test_responses_are_parsed_and_taken_apart_once(spark):
    """Checks look at fields that were taken out before, not into the whole response again and again."""
    from vitrine.operators import responses as rs

    raw = spark.createDataFrame([("a", "{}")], "request_id string, raw_response string")
    for parsed in (rs.link_decisions, rs.supersession_decisions, rs.evidence_judgments):
        plan = optimized(parsed(raw))
        assert plan.count("tryParseJson") + plan.count("try_parse_json") + plan.count("parseJson(") <= 1
        error = next(line for line in plan.splitlines() if "AS schema_error" in line)
        assert "$.confidence" not in error.split("AS schema_error")[0] and "$.criteria_scores" not in error.split("AS schema_error")[0]


def test_pairs_are_made_once_and_not_shuffled(spark, sf):
    """A hot name's pairs leave the join as they are made: no exchange of theirs follows it, for prompts and asked pairs alike."""
    from vitrine.plans.evidence import jud1_links
    from vitrine.plans.relational import jon7_link_candidates

    for query in (jon7_link_candidates, jud1_links):
        plan = executed(query(spark, sf))
        assert plan.count("SortMergeJoin [tail") == 1 and "Exchange" not in plan.split("SortMergeJoin [tail")[0]
    cap = spark.createDataFrame([(1, "pypi:x", "library"), (2, "npm:x", "library"), (3, "source:github:o/x", "repo")], "id long, normalized_key string, component_kind string")
    asked = spark.createDataFrame([(1, 3)], "library_id long, repo_id long")
    assert [(r["library_id"], r["repo_id"]) for r in registry.link_candidates(cap, asked).collect()] == [(2, 3)]


def test_evidence_is_joined_once_for_fits(spark, sf, monkeypatch):
    """All steps of a fit read one written join of the evidence's tables, and results meet the members of a class as its columns."""
    from vitrine.plans import policy

    real, seen = policy.written, []
    monkeypatch.setattr(policy, "written", lambda df, name: seen.append((name, optimized(df).count("lineitem") + optimized(df).count("l_orderkey") > 0)) or real(df, name))
    for query in (policy.fit4_fit, policy.fit4_links, policy.jon9_requirements, policy.rec1_rules, policy.win5_ranks, policy.rec2_recommend, policy.rec3_trace):
        seen.clear()
        last = optimized(query(spark, sf))
        assert [n for n, joins in seen if joins] == ["evidence"] * any(n == "evidence" for n, _ in seen)
        if query is not policy.fit4_links:
            assert "evidence" in [n for n, _ in seen] and "l_orderkey" not in last
    plan = optimized(policy.fit4_fit(spark, sf))
    assert "results" not in plan.split("Join Inner")[0]


def test_links_are_not_shuffled(spark):
    """Links leave a version's evidence as they are made: one exchange by version, no distinct; rows of one id are one item."""
    from vitrine.operators import fit

    asks = [(1, "license_allowlist", "mit"), (1, "license_allowlist", "mit,isc"), (2, "license_allowlist", "isc"), (3, "license_allowlist", "")]
    constraints = spark.createDataFrame([(*a, None, None, None) for a in asks], "req_id long, kind string, spdx_ids string, name string, fragment string, ecosystem string")
    said = [(7, "a", "MIT"), (7, "a", "MIT"), (7, "b", None), (8, "c", "ISC"), (8, "c", "GPL")]
    evidence = spark.createDataFrame([(v, e, "license", s, None, None, None) for v, e, s in said], "version_id long, evidence_id string, evidence_type string, spdx_id string, name string, ecosystem string, signature string")
    links = fit.fit_links(constraints, evidence)
    plan = executed(links)
    s, g = "supports_match", "documents_gap"
    # the allowlist of mit alone is met by version 7 only, that of isc alone by version 8 only; a malformed one has no links
    want = [(1, 7, "a", s), (1, 8, "c", g), (1, 8, "c", s), (2, 7, "a", g), (2, 7, "b", g), (2, 8, "c", s)]
    assert sorted(map(tuple, links.collect())) == want
    assert plan.count("Exchange hashpartitioning(version_id") == 1 and "hashpartitioning(req_id" not in plan


def test_counts_before_a_range_are_few(spark, monkeypatch):
    """Ranges hold about as many candidates each, however sparse their ids; ranks stay the same."""
    from pyspark.sql import functions as F

    from vitrine.operators import fit

    monkeypatch.setattr(fit, "_RANGE_ROWS", 100)
    rows = spark.range(1000).select(F.lit(1).alias("req_id"), (F.col("id") * F.col("id") * 1_000_003).alias("version_id"), F.lit("0.500").cast("decimal(18,3)").alias("intrinsic_score"), F.lit("1.000").cast("decimal(6,3)").alias("fit_score"), F.lit(0).cast("long").alias("blocking_gap_count"))
    cuts = fit.id_cuts(rows)
    sizes = [r["count"] for r in rows.groupBy(fit.id_range(cuts).alias("v")).count().collect()]
    assert len(sizes) == len(cuts) + 1 == 11 and max(sizes) < 200
    got = fit.ranked(rows, cuts=cuts).orderBy("version_id").select("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001))
    assert fit.id_cuts(rows.limit(50)) == []


def test_stage_terms_make_no_index(spark, sf, monkeypatch):
    """One look at the components finds the hits of all terms, written once for their heads and their candidates."""
    from vitrine.operators import textindex
    from vitrine.plans import evidence

    real, names = evidence.written, []
    monkeypatch.setattr(evidence, "written", lambda df, name: names.append(name) or real(df, name))
    monkeypatch.setattr(textindex, "build", lambda *a, **k: pytest.fail("an index was made for one use"))
    assert evidence.jon11_adjacent(spark, sf).count() == 6 and names == ["hits", "stages"]


def test_archives_are_packed_and_opened_once(spark, sf):
    """No branch packs the archives again for those that are refused, and small archives share a frame."""
    from vitrine.plans.registry import src6_archives

    plan = optimized(src6_archives(spark, sf))
    assert plan.count("MapInPandas packed") + plan.count("MapInPandas opened") == 2


def test_facts_are_made_once_for_transitions(spark, sf, monkeypatch):
    """Acceptances, guards and versions come from one written aggregate."""
    from vitrine.plans import common, policy

    plan = optimized(policy.lif2_transitions(spark, sf))
    assert "l_orderkey" not in plan and "rightHint=(strategy=broadcast)" in plan
    assert "l_orderkey" not in optimized(common.decided(spark, sf))


def test_evidence_is_looked_at_once_for_fits(spark, sf, monkeypatch):
    """One aggregate tells what fits look at; what is written and read again has a row for each version, not each item."""
    from vitrine.plans import policy
    from vitrine.sources.views import view

    real, seen = policy.written, {}
    monkeypatch.setattr(policy, "written", lambda df, name: seen.setdefault(name, real(df, name)))
    versions = view(spark, sf, "capability_version").count()
    for query in (policy.CATALOGUE.queries["fit1_interface"], policy.CATALOGUE.queries["fit2_license"], policy.rec1_rules, policy.win5_ranks):
        seen.clear()
        last = optimized(query(spark, sf))
        assert "candidates" not in seen and "l_orderkey" not in last
        assert seen["evidence"].count() == seen["evidence"].select("version_id").distinct().count() == versions


def test_gates_look_up_no_pins(spark, sf, monkeypatch):
    """A gate asks for the verdict only: no pin is looked up for it, and evidence isn't written by item."""
    from vitrine.plans import policy

    real, seen = policy.written, {}
    monkeypatch.setattr(policy, "written", lambda df, name: seen.setdefault(name, real(df, name)))
    monkeypatch.setattr(policy.fit, "pins", lambda *a: pytest.fail("pins were looked up"))
    for query in (policy.pol12_build_gate, policy.pol13_authorizable):
        seen.clear()
        plan = optimized(query(spark, sf))
        assert "l_orderkey" not in plan and "revision_id" not in seen["evidence"].columns


def test_fits_are_hashed_where_evidence_streams(spark, sf, monkeypatch):
    """No row of a pair is written or shuffled for its hash: only versions and their evidence are, once for the digests."""
    from vitrine.plans import policy

    real, seen = policy.written, []
    monkeypatch.setattr(policy, "written", lambda df, name: seen.append((name, df.columns)) or real(df, name))
    plan = executed(policy.fit4_hash(spark, sf))
    assert not [name for name, columns in seen if {"req_id", "version_id"} <= set(columns) and name != "scope"]
    last, _, before = plan.partition("MapInArrow")
    assert "Exchange" not in last and before and "explode(results" not in before and "CartesianProduct" not in before and "NestedLoop" not in before


def test_fit_hashes_of_long_streams(spark, monkeypatch):
    """Links that go into digests bit by bit, requirements in several passes, and candidates that meet requirements everywhere
    give the hashes of pairs; rows of one id are one item, and one without an id is an item of its own."""
    import hashlib
    import json

    from pyspark.sql import functions as F

    from vitrine.operators import fit

    asks = [(r, "license_allowlist", "mit", None, None) for r in range(5)] + [(r, "forbidden_dependency", None, "foo", "npm") for r in (1, 3)] + [(4, "license_allowlist", "isc", None, None)]
    constraints = spark.createDataFrame(asks, "req_id int, kind string, spdx_ids string, name string, ecosystem string").withColumn("fragment", F.lit(None).cast("string"))
    said = [(7, f"e{i:04}", "license", "MIT", None, None) for i in range(300)] + [(7, "e0005", "license", "GPL", None, None), (7, None, "license", "MIT", None, None), (7, "", "dependency", None, "Foo", "NPM")]
    said += [(8, 'q"\u00e9', "license", "ISC", None, None), (9, "x", "license", "MIT", None, None)]  # 9 is no candidate
    evidence = spark.createDataFrame([(*s, None) for s in said], "version_id long, evidence_id string, evidence_type string, spdx_id string, name string, ecosystem string, signature string")
    requirements = spark.range(6).select(F.col("id").cast("int").alias("req_id"))
    candidates = spark.createDataFrame([(7, 1), (8, 1), (6, 1)], "version_id long, intrinsic_score int")
    facts = fit.candidate_facts(constraints, candidates, evidence)
    pairs = fit.pairs(requirements, constraints, facts).where("req_id <> 2 or version_id = 8")
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(fit.fit_hashes(requirements, constraints, pairs, evidence))
    assert len(want) == 16
    link = lambda e, role: {"evidence_item_id": e, "role": role}
    found = {"kind": "forbidden_dependency_present", "is_blocking": True, "detail": {"ecosystem": "npm", "name": "foo", "occurrences": 1}}
    licence, dependency = {"kind": "license_allowlist", "detail": {"spdx_ids": ["mit"]}}, {"kind": "forbidden_dependency", "detail": {"ecosystem": "npm", "name": "foo"}}
    links = [link("", "supports_match"), link("", "documents_gap")] + [link(f"e{i:04}", "supports_match") for i in range(300)]
    told = {"requirement_id": "1", "capability_version_id": "7", "fit_score": "0.500", "gaps": [found], "links": links, "constraint_shape": [dependency, licence]}
    assert (1, 7, hashlib.sha256(json.dumps(told, sort_keys=True, separators=(",", ":")).encode()).hexdigest()) in want
    asked, everywhere = spark.createDataFrame([(2, 8)], "req_id int, version_id long"), requirements.where("req_id <> 2")
    for waiting, hashes, texts, most in ((1, 1, 1, 8), (1000, 7, 50_000, 100_000)):
        for name, value in (("_WAITING", waiting), ("_HASHES", hashes), ("_TEXTS", texts), ("BROADCAST_ROWS", most)):
            monkeypatch.setattr(fit, name, value)
        assert rows(fit.fit_hashes(requirements, constraints, pairs, evidence)) == want
        assert rows(fit.fit_hashes(requirements, constraints, asked, evidence, facts, everywhere)) == want


def test_components_that_read_alike_share_a_prompt(spark, monkeypatch):
    """A prompt is made for groups of components, not for each pair; groups and blocks of any size give all pairs once."""
    from pyspark.sql import functions as F

    from vitrine.operators import judgment

    rows = [(i, f"pypi:{'hot' if i < 300 else 'cold'}", "library", "ab"[i % 2]) for i in range(303)] + [(1000 + i, f"source:github:x/{'hot' if i < 200 else 'cold'}", "repo", "c") for i in range(202)]
    rows += [(2000, "npm:hot", "library", None), (2001, "source:github:x/alone", "repo", "c"), (2002, "pypi:hot", "skill", "a")]
    cap = spark.createDataFrame(rows, "id long, normalized_key string, component_kind string, description string").withColumn("display_name", F.lit("n")).withColumn("gemini_description", F.lit(None).cast("string"))
    sides = judgment.with_link_text(cap)
    told = lambda pairs: sorted(map(tuple, judgment.link_prompts_of(pairs).select("library_id", "repo_id", "prompt_hash").collect()))
    want = told(registry.link_candidates(sides, carried=("told",)))
    assert len(want) == 301 * 200 + 3 * 2
    for alike, block in ((128, 1000), (128, 20), (7, 30), (1, 1000)):
        monkeypatch.setattr(registry, "ALIKE", alike)
        groups = registry.alike_groups(sides, "told")
        prompts = registry.alike_link_candidates(groups, "told", block)
        assert told(prompts.withColumn("library_id", F.explode("library_id")).withColumn("repo_id", F.explode("repo_id"))) == want
        assert groups.count() <= 11 + 503 / alike * 2 and (alike < 128 or prompts.count() <= 6 * 2 + 4)


def test_prompts_are_hashed_before_pairs_are_made(spark, sf):
    """The hash stands below the rows of pairs, and the few bytes of groups are not gathered into few tasks."""
    from vitrine.plans.evidence import jud1_links

    above, _, below = executed(jud1_links(spark, sf)).partition("SortMergeJoin [tail")
    assert above.count("Generate explode") == 2 and "sha2" in above.split("Generate explode")[2]
    assert below.count("REPARTITION_BY_NUM") == 2 and "to_json" not in below
