"""Every registered query of the registry against its SQL twin, or for rows where SQL has none."""

import pytest

from tests.conftest import same_rows
from vitrine.plans.catalogue import all_plans

QUERIES, SQL = all_plans()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, duck, name):
    same_rows(QUERIES[name](spark, sf), duck.sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["agg6_content_hash", "sco5_hash", "win5_ranks", "rec2_recommend"])
def test_partitioning_changes_nothing(spark, sf, name):
    """Results don't depend on how rows are dealt to tasks."""
    seen = []
    for n in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(str, QUERIES[name](spark, sf).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]


def test_filters_reach_the_scan(spark, sf):
    """Filters and needed columns are pushed to the files."""
    plan = QUERIES["src1_scan"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(p_size,40)" in plan and "ReadSchema: struct<p_partkey:bigint,p_name:string,p_size:int>" in plan
