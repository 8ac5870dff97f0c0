"""Plug-ins: extractors, gates and health dimensions of the caller's, next to the built-in ones.

A plug-in is checked when it is registered. Extractors run together in one pass over the files; one that raises, or gives
what it didn't declare, fails its own stage (a revision and an extractor) and nothing else. Gates bring aggregates of the
evidence with them, which join the one aggregate by version, and are judged within its rows like the built-in gates.
Health dimensions are columns over components, with a weight for each kind.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = re.compile(r"[a-z][a-z0-9_]*")
ITEM = "revision string, extractor string, path string, evidence_type string, name string, detail string, error string"
FACT_ROWS = "version_id long, revision_id long, evidence_type string, spdx_id string, name string"


@dataclass(frozen=True)
class Extractor:
    """extract(path, content) gives (evidence_type, name, detail) of each find in a file whose path meets the pattern paths;
    gives are the evidence types that it may use."""

    name: str
    paths: str
    gives: tuple[str, ...]
    extract: Callable[[str, str], Iterable[tuple[str, str, str | None]]]


@dataclass(frozen=True)
class Gate:
    """facts are aggregates over evidence rows; status (pass, warn or fail) and reason are columns over them."""

    name: str
    is_blocking: bool
    facts: dict[str, Column]
    status: Column
    reason: Column


@dataclass(frozen=True)
class HealthDimension:
    """raw (0 to 1) and has_evidence over a component's columns, with a weight for each kind that it counts for."""

    name: str
    raw: Column
    has_evidence: Column
    weights: dict[str, float]


@dataclass
class Plugins:
    extractors: list[Extractor] = field(default_factory=list)
    gates: list[Gate] = field(default_factory=list)
    dimensions: list[HealthDimension] = field(default_factory=list)

    def register(self, spark: SparkSession, *plugins) -> Plugins:
        """Adds plug-ins; one that can't work raises ValueError here, not when a job runs."""
        from vitrine.operators.policy import GATES
        from vitrine.operators.scoring import HEALTH_PROFILES, health_dimensions

        for p in plugins:
            if not NAME.fullmatch(p.name):
                raise ValueError(f"bad name {p.name!r}")
            own = {Extractor: self.extractors, Gate: self.gates, HealthDimension: self.dimensions}[type(p)]
            taken = {x.name for x in own} | {Gate: {g for g, _ in GATES}, HealthDimension: set(health_dimensions())}.get(type(p), set())
            if p.name in taken:
                raise ValueError(f"{p.name} is there already")
            if isinstance(p, Extractor):
                re.compile(p.paths)
                if not callable(p.extract) or not p.gives:
                    raise ValueError(f"{p.name}: no function, or nothing that it gives")
            elif isinstance(p, Gate):
                known = {f for g in self.gates for f in g.facts}
                if known & set(p.facts):
                    raise ValueError(f"{p.name}: facts {sorted(known & set(p.facts))} are there already")
                facts = spark.createDataFrame([], FACT_ROWS).groupBy("version_id").agg(*(c.alias(n) for n, c in p.facts.items()))
                types = facts.select(p.status.alias("status"), p.reason.alias("reason")).dtypes  # raises where columns are unknown
                if [t for _, t in types] != ["string", "string"]:
                    raise ValueError(f"{p.name}: status and reason have to be strings, not {types}")
            elif set(p.weights) - set(HEALTH_PROFILES) or not all(0 < w <= 1 for w in p.weights.values()):
                raise ValueError(f"{p.name}: weights from 0 to 1 for known kinds")
            own.append(p)
        return self

    def fact_columns(self) -> list[Column]:
        return [c.alias(n) for g in self.gates for n, c in g.facts.items()]


def extracted(files: DataFrame, extractors: list[Extractor]) -> DataFrame:
    """A row for each find of each extractor, and one with error for each file at which one failed."""

    def found(batches):
        import pandas as pd

        patterns = [(e, re.compile(e.paths)) for e in extractors]
        for pdf in batches:
            out = []
            for revision, path, content in zip(pdf["revision"], pdf["path"], pdf["content"]):
                for e, pattern in patterns:
                    if path is None or not pattern.search(path):
                        continue
                    try:
                        items = []
                        for kind, name, detail in e.extract(path, content or ""):
                            if kind not in e.gives or not isinstance(name, str) or not isinstance(detail, str | None):
                                raise ValueError(f"undeclared item {kind!r}")
                            items.append((revision, e.name, path, kind, name, detail, None))
                        out += items
                    except Exception as x:  # of the plug-in, whatever it is: only its stage fails
                        out.append((revision, e.name, path, None, None, None, f"{type(x).__name__}: {x}"[:400]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ITEM.split(", ")], dtype=object)

    return files.select("revision", "path", "content").mapInPandas(found, ITEM)


def stage_results(items: DataFrame) -> DataFrame:
    """revision, extractor, status, n_items and the least error of each stage that found or broke anything."""
    rows = items.groupBy("revision", "extractor").agg(F.min("error").alias("error"), F.count_if(F.col("error").isNull()).alias("n"))
    failed = F.col("error").isNotNull()
    return rows.select("revision", "extractor", F.when(failed, "failed").otherwise("succeeded").alias("status"), F.when(failed, 0).otherwise(F.col("n")).cast("long").alias("n_items"), "error")


def plugin_evidence(items: DataFrame) -> DataFrame:
    """revision, path, evidence_type, name and detail of the stages that didn't fail, to be joined to the built-in evidence."""
    failed = items.where("error is not null").select("revision", "extractor").distinct()
    return items.join(failed, ["revision", "extractor"], "left_anti").select("revision", "path", "evidence_type", "name", "detail")
