"""Helpers that the operators share: tables, the shared folder, checkpoints and grouped batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.sources.folders import new_folder, shared_dir, written

__all__ = ["checkpointed", "fresh", "groups", "new_folder", "shared_dir", "table", "with_rows", "written"]

#: A word is a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no recomputation of its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: an operator's own columns can't clash with others of its input."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def with_rows(docs: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, bool]:
    """docs with a column row, a long that no two rows share and that rises with doc_id, nulls last; and whether that is
    doc_id itself. It is where doc_id is a key; otherwise the rows are sorted and written down with their numbers."""
    spark = docs.sparkSession
    again = fresh(docs, doc_id).toDF("id").groupBy("id").count().where("count > 1 or id is null")
    if not again.take(1):
        return docs.withColumn("row", F.col(f"`{doc_id}`")), True
    path = new_folder(spark, "rows")
    # the second sort column lets one repeated doc_id go over many partitions
    dealt = docs.withColumn("row", F.monotonically_increasing_id()).orderBy(F.col(f"`{doc_id}`").asc_nulls_last(), "row")
    dealt.withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path), False


def groups(batches, key: str):
    """Yields (value, arrays by column) for each run of equal keys in batches that Spark has sorted by key."""
    held: list[dict] = []
    held_key = None
    for pdf in batches:
        if not len(pdf):
            continue
        keys = pdf[key].to_numpy()
        cols = {c: pdf[c].to_numpy() for c in pdf.columns}
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for s, e in zip([0, *cuts], [*cuts, len(keys)]):
            if held and held_key != keys[s]:
                yield held_key, _joined(held)
                held = []
            held_key = keys[s]
            held.append({c: v[s:e] for c, v in cols.items()})
    if held:
        yield held_key, _joined(held)


def _joined(parts: list[dict]) -> dict:
    return parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
