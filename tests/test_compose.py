"""Stage candidates: the search widens as said, and only the top-k window is left."""

from vitrine.plans import catalogue  # noqa: F401
from vitrine.plans.compose import stage_candidates


def test_stage_candidates(spark):
    kinds = ["tool", "tool", "repo", "repo", "tool"]
    names = ["alpha one", "beta", "alpha two", "gamma", "beta gamma"]
    cap = spark.createDataFrame([(i, n, "r", k, float(i)) for i, (n, k) in enumerate(zip(names, kinds))], "id long, display_name string, runtime string, component_kind string, score double")
    terms = spark.createDataFrame([(0, 0, "none", "tool"), (0, 1, "alpha", "tool"), (0, 2, "beta", "tool"), (1, 0, "gamma", "skill"), (1, 1, "alpha", "skill")], "stage int, term int, word string, want string")
    df = stage_candidates(cap, terms, "score")
    assert sorted((r["stage"], r["rank"], r["id"]) for r in df.collect()) == [(0, 1, 4), (0, 2, 1), (0, 3, 0), (1, 1, 4), (1, 2, 3)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "WindowGroupLimit" in plan
