"""Plug-ins are checked when registered, and one that fails takes nothing else with it."""

import pytest
from pyspark.sql import functions as F

from vitrine.operators import plugins as p

FILES = "revision string, path string, content string"


def test_bad_plugins_are_refused(spark):
    good = p.Extractor("notes", r"\.md$", ("note",), lambda path, content: [])
    gate = lambda **k: p.Gate(**({"name": "own", "is_blocking": True, "facts": {"n": F.count("*")}, "status": F.lit("pass"), "reason": F.lit("")} | k))
    mine = p.Plugins().register(spark, good, gate())
    bad = [good, p.Extractor("Bad name", "x", ("note",), print), p.Extractor("nothing", "x", (), print), p.Extractor("no_function", "x", ("note",), None), gate(name="missing_provenance", facts={"m": F.count("*")}), gate(name="again"),
           gate(name="typed", facts={"m": F.count("*")}, status=F.col("m")), p.HealthDimension("freshness", F.lit(1), F.lit(True), {}), p.HealthDimension("new", F.lit(1), F.lit(True), {"robot": 0.5}), p.HealthDimension("heavy", F.lit(1), F.lit(True), {"repo": 2})]
    for b in bad:
        with pytest.raises(ValueError):
            mine.register(spark, b)
    with pytest.raises(Exception, match="UNRESOLVED"):
        mine.register(spark, gate(name="unknown_column", facts={"m": F.count("*")}, status=F.col("nowhere")))
    with pytest.raises(Exception):
        mine.register(spark, p.Extractor("pattern", "(", ("note",), print))
    assert [e.name for e in mine.extractors] == ["notes"] and [g.name for g in mine.gates] == ["own"]


def test_one_failure_is_one_stage(spark):
    def breaks(path, content):
        yield "note", "before", None
        raise KeyError(content)

    def undeclared(path, content):
        return [("secret", "x", None)] if content == "b" else [("note", "x", content)]

    mine = p.Plugins().register(spark, p.Extractor("breaks", "a$", ("note",), breaks), p.Extractor("undeclared", ".", ("note",), undeclared), p.Extractor("works", "a", ("note", "more"), lambda path, content: [("more", path, content)] * 2))
    files = spark.createDataFrame([("r1", "a", "a"), ("r1", "ab", "b"), ("r2", "b", None), ("r3", None, "x")], FILES)
    items = p.extracted(files, mine.extractors)
    got = sorted((r["revision"], r["extractor"], r["status"], r["n_items"]) for r in p.stage_results(items).collect())
    assert got == [("r1", "breaks", "failed", 0), ("r1", "undeclared", "failed", 0), ("r1", "works", "succeeded", 4), ("r2", "undeclared", "succeeded", 1)]
    kept = sorted((r["revision"], r["name"], r["detail"]) for r in p.plugin_evidence(items).collect())
    assert kept == [("r1", "a", "a"), ("r1", "a", "a"), ("r1", "ab", "b"), ("r1", "ab", "b"), ("r2", "x", "")]
    assert p.stage_results(p.extracted(files.limit(0), mine.extractors)).count() == 0
