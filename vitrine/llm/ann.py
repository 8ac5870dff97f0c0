"""Nearest neighbours of a stated query set by a block matrix join over int8 codes.

Queries and candidates are dealt into row and column groups of bounded size; each cell of the grid is one group of a
cogroup. In a cell, tiles of int8 codes are multiplied (in float32, which is exact for codes up to MAX_DIM components),
which gives distances between the decoded vectors; a vector's own quantisation error bounds each true distance from both
sides. Only pairs whose lower bound is within the k-th least upper bound of their query are computed again, in double
precision, and kept in a heap of k per query. The cells' heaps are merged per query by a heap as well. Nothing is lost:
the bounds are strict, and pairs of vectors so large or small that their squares leave the range of doubles have no
bounds and are all computed again, so the result is that of a full search. A cell's sizes follow from the bytes of its
vectors.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, neither do rows
without an id; vectors of another length than the query's are not near it; a query id that repeats is searched by its
least vector; candidates that repeat are separate candidates; ties go to the smaller id; a distance over the range of
doubles is infinite.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import fresh, groups, table

#: Bytes of a cell's queries and of its candidates, as doubles.
ROW_BYTES, COLUMN_BYTES = 1 << 24, 1 << 26
#: Largest component of vectors whose squares and products of squares are ordinary doubles.
TAME = (1e-140, 1e140)
QUERY_TILE, TILE = 512, 4096
#: 127 * 127 * dim stays below 2**24.
MAX_DIM = 1040


def quantise(vectors):
    """codes (int8), scale and error for each row of a float64 matrix: |row - scale * codes| is error, infinite for vectors
    that are not TAME, which are not coded."""
    most = np.abs(vectors).max(axis=1)
    tame = (most > TAME[0]) & (most < TAME[1])
    vectors = np.where(tame[:, None], vectors, 1.0)
    scale = np.where(tame, most, 1.0) / 127
    codes = np.rint(vectors / scale[:, None])
    error = np.sqrt(((vectors - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes.astype(np.int8), scale, np.where(tame, error, np.inf)


def distance(a, b):
    """Euclidean distance of rows, in double precision, the squares added in the order of the components."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore", under="ignore"):
        for j in range(a.shape[1]):
            d = a[:, j] - b[:, j]
            total += d * d
    return np.sqrt(total)


def cell(queries, query_ids, rows, row_ids, k: int):
    """(query index, score, id) of each query's k nearest rows in one cell, by bounds on int8 tiles first."""
    heaps: list[list] = [[] for _ in range(len(queries))]
    row_codes, row_scale, row_error = quantise(rows)
    step = TILE if rows.shape[1] <= MAX_DIM else 1024
    kind = np.float32 if rows.shape[1] <= MAX_DIM else np.float64
    for qs in range(0, len(queries), QUERY_TILE):
        q = queries[qs : qs + QUERY_TILE]
        codes, scale, error = quantise(q)
        own = (codes.astype(np.float64) ** 2).sum(axis=1) * scale**2
        best = np.full((len(q), 0), np.inf)
        for cs in range(0, len(rows), step):
            c = slice(cs, cs + step)
            products = codes.astype(kind) @ row_codes[c].astype(kind).T
            norm = (row_codes[c].astype(np.float64) ** 2).sum(axis=1) * row_scale[c] ** 2
            square = own[:, None] + norm[None, :] - 2 * scale[:, None] * row_scale[c][None, :] * products
            slack = (error[:, None] + row_error[c][None, :]) + 1e-7 * np.sqrt(own[:, None] + norm[None, :])
            near = np.sqrt(np.maximum(square, 0))
            other = query_ids[qs : qs + QUERY_TILE, None] != row_ids[c][None, :]
            upper = np.where(other, near + slack, np.inf)
            if upper.shape[1] > k:
                upper = np.partition(upper, k - 1, axis=1)[:, :k]
            best = np.concatenate([best, upper], axis=1)
            if best.shape[1] > k:
                best = np.partition(best, k - 1, axis=1)[:, :k]
            bound = best.max(axis=1) if best.shape[1] == k else np.full(len(q), np.inf)
            qi, ci = np.nonzero(other & (near - slack <= bound[:, None]))  # infinite slack: always
            for at in range(0, len(qi), 1 << 16):
                a, b = qi[at : at + (1 << 16)], ci[at : at + (1 << 16)] + cs
                for i, s, name in zip((a + qs).tolist(), distance(q[a], rows[b]).tolist(), row_ids[b].tolist()):
                    item = (-s, -name)
                    if len(heaps[i]) < k:
                        heapq.heappush(heaps[i], item)
                    elif item > heaps[i][0]:
                        heapq.heapreplace(heaps[i], item)
    return [(i, -s, -name) for i, h in enumerate(heaps) for s, name in h]


def usable(vector: str) -> Column:
    """True for vectors that take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def nearest(queries: DataFrame, rows: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows nearest to each query, its own id left out."""
    cols = [F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector")]
    rows = rows.select(*cols).where(F.col("vec_id").isNotNull() & usable("vector"))
    queries = queries.select(*cols).where(F.col("vec_id").isNotNull() & usable("vector")).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    one = F.max(8 * F.size("vector"))
    (n_rows, wide), (n_queries, long) = rows.agg(F.count("*"), one).first(), queries.agg(F.count("*"), one).first()
    per_row, per_query = max(1, COLUMN_BYTES // (wide or 8)), max(1, ROW_BYTES // (long or 8))
    r, c = max(1, -(-n_queries // per_query)), max(2 if n_rows > 2000 else 1, -(-n_rows // per_row))
    c = max(c, min(rows.sparkSession.sparkContext.defaultParallelism, n_rows // 2000))  # no fewer cells than there are cores
    dealt = lambda n: F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("vec_id", "vector", F.pmod(F.xxhash64("vec_id"), F.lit(r)).cast("int").alias("r"), every(c).alias("c"))
    right = rows.select("vec_id", "vector", dealt(c).alias("c")).select("vec_id", "vector", "c", every(r).alias("r"))

    def searched(q, x):
        import pandas as pd

        out = []
        if len(q) and len(x):
            dims, sizes = q["vector"].map(len).to_numpy(), x["vector"].map(len).to_numpy()
            for dim in np.unique(dims):
                a, b = q[dims == dim], x[sizes == dim]
                if len(b):
                    ids = a["vec_id"].to_numpy()
                    found = cell(np.stack(a["vector"]), ids, np.stack(b["vector"]), b["vec_id"].to_numpy(), k)
                    out += [(ids[i], name, s) for i, s, name in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    def merged(batches):
        import pandas as pd

        for query, g in groups(batches, "query_id"):
            best = heapq.nsmallest(k, zip(g["score"].tolist(), g["vec_id"].tolist()))
            yield pd.DataFrame([(query, i + 1, name, s) for i, (s, name) in enumerate(best)], columns=["query_id", "rank", "vec_id", "score"])

    found = left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInPandas(searched, "query_id long, vec_id long, score double")
    # at most k rows of each query from each cell
    return found.repartition("query_id").sortWithinPartitions("query_id").mapInPandas(merged, "query_id long, rank int, vec_id long, score double")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fresh(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest(rows.where(F.col("vec_id") % 100 == 0), rows)


QUERIES = {"op4_ann": op4_ann}
ORACLE_SQL = {
    "op4_ann": """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score FROM v AS q JOIN v AS c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
  WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p) WHERE rank <= 10"""
}
