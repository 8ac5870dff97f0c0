"""Search, browse, detail and reports over the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators import scoring, textindex
from vitrine.operators.policy import constraint_verdicts

FILTERS = ("ecosystem", "kind", "component_kind", "runtime", "cost_tier")


def where_given(df: DataFrame, **values) -> DataFrame:
    """The ANDed equality filters that are given; one that is None is no filter."""
    for name, value in values.items():
        if name not in FILTERS:
            raise ValueError(f"no filter {name}")
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def matching(query: str) -> Column:
    """Substring without case in name or key; % and _ in the query are wildcards."""
    return F.ilike("display_name", F.lit(f"%{query}%")) | F.ilike("normalized_key", F.lit(f"%{query}%"))


def clamp(limit: int, most: int) -> int:
    return max(1, min(most, limit))


def heads(versions: DataFrame) -> DataFrame:
    """capability_id, year and version_id of the newest version of each capability, combined before the shuffle."""
    newest = versions.groupBy("capability_id").agg(F.max(F.struct("year", "version_id")).alias("v"))
    return newest.select("capability_id", "v.year", "v.version_id")


def with_head(capability: DataFrame, versions: DataFrame, evidence: DataFrame, *more: Column) -> DataFrame:
    """Each capability with its head version and that version's score, and further aggregates of its evidence; without one
    they are null. Only the heads of the given capabilities are looked up, and only their evidence is scored."""
    ids = capability.select(F.col("id").alias("capability_id"))
    head = heads(versions.join(ids, "capability_id", "left_semi")).select(F.col("capability_id").alias("id"), "version_id")
    own = evidence.join(head.select("version_id"), "version_id", "left_semi")
    facts = own.groupBy("version_id").agg(*scoring.dimension_aggregates(), *more)
    scored = facts.withColumns(scoring.card_columns())
    return capability.join(head.join(scored, "version_id", "left"), "id", "left")


def best_first(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(F.coalesce(F.col("total_score"), F.lit(0)).desc(), F.asc("display_name"), F.asc("id")).limit(limit)


def search(
    capability, versions, evidence, query: str, limit: int = 20, constraints: DataFrame | None = None, project_id: int | None = None, index: str | None = None, **filters
) -> DataFrame:
    """The best matches of a query; a blank query has none. With a project, those of them that its constraints let pass: as
    the limit comes first, there may be fewer. With the path of a text index only what its posting lists name is looked at."""
    query = query.strip()
    rows = where_given(textindex.narrowed(capability, index, query) if index and query else capability, **filters).where(matching(query) if query else F.lit(False))
    return fitting(best_first(with_head(rows, versions, evidence), clamp(limit, 100)), constraints, project_id)


def browse(capability, versions, evidence, limit: int = 50, constraints: DataFrame | None = None, project_id: int | None = None, **filters) -> DataFrame:
    """The best components under the filters, then the project's constraints as in search."""
    rows = with_head(where_given(capability, **filters), versions, evidence)
    return fitting(best_first(rows, clamp(limit, 500)), constraints, project_id)


def fitting(rows: DataFrame, constraints: DataFrame | None, project_id: int | None) -> DataFrame:
    """rows that no constraint of the project rejects, each row checked against the project's few constraints."""
    if project_id is None or constraints is None:
        return rows
    own = constraints.where(F.col("project_id") == project_id)
    failed = constraint_verdicts(rows, own).where(~F.col("passed")).select(F.col("capability_id").alias("id")).distinct()
    return rows.join(failed, "id", "left_anti")


def detail(capability: DataFrame, versions: DataFrame, evidence: DataFrame) -> DataFrame:
    """One document for each capability: id, head (version_id and year left out where there is none), interfaces and
    dependencies of the head as arrays of structs sorted by name, and its scorecard with the array of its dimensions.

    The arrays hold one version's items, which is what a reader of the document asks for."""
    of = lambda t, *cols: F.array_sort(F.collect_list(F.when(F.col("evidence_type") == t, F.struct(*cols))))
    more = [of("interface", "name", "evidence_id", "signature").alias("interfaces"), of("dependency", "ecosystem", "name", "evidence_id").alias("dependencies")]
    rows = with_head(capability, versions, evidence, *more)
    text = lambda x, *names: [x[n].cast("string").alias(n) for n in names]
    dimensions = [F.struct(x["dimension"].alias("name"), x["n"].alias("evidence_count"), *text(x, "raw", "weight", "weighted"), x["coverage"].alias("coverage"), x["contradiction"].alias("contradiction")) for x in scoring.dimension_rows()]
    by_name = F.array_sort(F.array(*dimensions))
    card = F.when(F.col("total_score").isNotNull(), F.struct(F.col("total_score").cast("string").alias("total_score"), F.col("confidence").cast("string").alias("confidence"), by_name.alias("dimensions")))
    listed = [F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c) for c in ("interfaces", "dependencies")]
    return rows.select("id", "normalized_key", "display_name", "version_id", *listed, card.alias("scorecard"))


def representative_interface(evidence: DataFrame, versions: DataFrame) -> DataFrame:
    """capability_id and the name and signature of the first interface, by name, over all of its heads."""
    rows = evidence.where("evidence_type = 'interface'").join(heads(versions), "version_id")
    return rows.groupBy("capability_id").agg(F.min(F.struct("name", "signature")).alias("i")).select("capability_id", "i.name", "i.signature")


def info(capability: DataFrame, health: DataFrame, top: int = 10) -> DataFrame:
    """Counts by component kind and by cost tier (null is a tier) and the best health scores, as (section, name, value)."""
    kinds = capability.groupBy("component_kind").agg(F.count("*").alias("n")).select(F.lit("kind").alias("section"), F.col("component_kind").alias("name"), F.col("n").cast("double").alias("value"))
    tiers = capability.groupBy("cost_tier").agg(F.count("*").alias("n")).select(F.lit("tier").alias("section"), F.col("cost_tier").alias("name"), F.col("n").cast("double").alias("value"))
    best = health.orderBy(F.desc("total"), F.asc("capability_id")).limit(top).select(F.lit("top").alias("section"), F.col("capability_id").cast("string").alias("name"), F.col("total").alias("value"))
    return kinds.unionByName(tiers).unionByName(best)
