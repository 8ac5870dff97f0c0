"""A trigram index for substring search: posting lists narrow a query to few components, which are then verified.

build() writes (gram, id) for every three characters in a row of the lower-case texts, sorted by gram, so that a lookup
reads the row groups of its grams only, and the number of components of each gram. A query's fixed stretches (% and _ are
wildcards) hold grams that every match has; the rarest of them are looked up. Queries without three fixed characters in a
row, or with a backslash, which escapes, aren't narrowed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
#: Grams of a query that are looked up, the rarest first.
LOOKUPS = 4


def grams(text: Column) -> Column:
    """The distinct grams of a text in lower case; none for a shorter text."""
    low = F.lower(text)
    places = F.sequence(F.lit(1), F.length(low) - (GRAM - 1))
    return F.when(F.length(low) >= GRAM, F.array_distinct(F.transform(places, lambda i: F.substr(low, i, F.lit(GRAM))))).otherwise(F.array())


def build(rows: DataFrame, columns: list[str], path: str, id: str = "id") -> None:
    """Writes the index of rows over the given text columns."""
    own = F.array_distinct(F.flatten(F.array(*(F.coalesce(grams(F.col(c)), F.array().cast("array<string>")) for c in columns))))
    postings = rows.select(F.col(id).alias("id"), F.explode(own).alias("gram"))
    # ranges of (gram, id): a gram that most components have goes over several files
    postings.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.parquet(f"{path}/postings")
    counted = rows.sparkSession.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count("*").alias("n"))
    counted.orderBy("gram").write.parquet(f"{path}/grams")


def needed(spark: SparkSession, query: str) -> set[str]:
    """The grams that every match of a query holds; lower case is Spark's, as for the texts."""
    if "\\" in query:
        return set()
    found: set[str] = set()
    for part in re.split("[%_]", query):
        low = spark.range(1).select(F.lower(F.lit(part)).alias("p")).first()["p"]
        found |= {low[i : i + GRAM] for i in range(len(low) - GRAM + 1)}
    return found


def rarest(spark: SparkSession, path: str, wanted: set[str]) -> list[str] | None:
    """The rarest of the wanted grams; None where one of them occurs nowhere, and so no text holds all."""
    counts = {r["gram"]: r["n"] for r in spark.read.parquet(f"{path}/grams").where(F.col("gram").isin(*sorted(wanted))).collect()}  # at most a query's grams
    return None if len(counts) < len(wanted) else sorted(counts, key=lambda g: (counts[g], g))[:LOOKUPS]


def narrowed(rows: DataFrame, path: str, query: str, id: str = "id") -> DataFrame:
    """rows, without most of those that can't hold the query; matches have to be verified."""
    spark = rows.sparkSession
    wanted = needed(spark, query)
    if not wanted:
        return rows
    looked_up = rarest(spark, path, wanted)
    if looked_up is None:
        return rows.where(F.lit(False))
    lists = spark.read.parquet(f"{path}/postings").where(F.col("gram").isin(*looked_up))
    ids = lists.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(looked_up)).select(F.col("id").alias(id))
    return rows.join(ids, id, "left_semi")


def narrowed_to_any(rows: DataFrame, path: str, queries: list[str], id: str = "id") -> DataFrame:
    """rows that may hold any of a few queries, by one look at the posting lists; all rows where one of them has no grams."""
    spark = rows.sparkSession
    asked = [(i, needed(spark, q)) for i, q in enumerate(queries)]
    if any(not w for _, w in asked):
        return rows
    lookups = [(i, g, len(found)) for i, w in asked if (found := rarest(spark, path, w)) for g in found]
    if not lookups:
        return rows.where(F.lit(False))
    lists = spark.read.parquet(f"{path}/postings").where(F.col("gram").isin(*sorted({g for _, g, _ in lookups})))
    told = F.broadcast(spark.createDataFrame(lookups, "query int, gram string, of int"))  # LOOKUPS for each query
    ids = lists.join(told, "gram").groupBy("query", "id").agg(F.count("*").alias("n"), F.first("of").alias("of")).where("n = of")
    return rows.join(ids.select(F.col("id").alias(id)).distinct(), id, "left_semi")
