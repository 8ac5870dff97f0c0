"""Collects the queries and SQL twins of all plan modules."""

from __future__ import annotations

from vitrine.sources.views import with_views


class Catalogue:
    """Queries by name, each with SQL for DuckDB where SQL can express it."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        """Registers fn(spark, sf_dir) -> DataFrame as a query."""

        def put(fn):
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = with_views(sql)
            return fn

        return put


def all_plans() -> tuple[dict, dict]:
    from vitrine.plans import evidence, policy, query, registry, relational, scoring, workflow

    queries: dict = {}
    sql: dict[str, str] = {}
    for m in (query, relational, scoring, policy, registry, evidence, workflow):
        queries |= m.CATALOGUE.queries
        sql |= m.CATALOGUE.sql
    return queries, sql
