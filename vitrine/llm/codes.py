"""Vector codes: product quantisation in exact integers.

A component x is the integer floor(scale * x), and a vector is cut into equal parts. Each part position has a codebook, and
a part's code is the first entry at the least squared distance |p|^2 - 2 p.c + |c|^2. The products p.c of a batch are a
matrix product in float64 BLAS that is exact: integers are broken into limbs so small that no sum of products of limbs
reaches 2^53, and the limbs' products are put together in int64. Where distances could leave int64, Python's integers take
the place of both.

Codebooks start as given rows and are refined by rounds. A round is one pass over the vectors: each task adds up the parts of
each entry, Spark adds the tasks' sums, and only the sums of the codebooks (parts x entries x components) come to the
driver, where entries become floor(sum / count). Sums travel as digits of 40 bits, so they can't overflow. The vectors are
written to the shared folder once, so a lost executor costs a reread.

Defined cases: null vectors and those with null or non-finite components have no row. Codebooks start from the rows of the
smallest ids, nulls last, then by vector; where there are fewer rows than entries, codebooks have fewer. Rows that repeat an
id, or have none, are coded each on their own. The first row whose length is a positive multiple of the number of parts sets
the length; vectors of another length keep their row, with null code and error, and count in no sum. An error over the
range of long is null. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import fresh, table, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Bits of the digits in which sums travel.
DIGIT = 40
LONG = (1 << 63) - 1


def _most(a) -> int:
    """The greatest absolute value."""
    return max(int(a.max()), -int(a.min())) if a.size else 0


def limbs(a, bits: int) -> list:
    """float64 matrices l with a = sum of l[i] * 2^(bits * i); all are below 2^bits in size, the last may be negative."""
    n = max(1, -(-_most(a).bit_length() // bits))
    low = np.int64((1 << bits) - 1)
    return [((a >> (bits * i)) if i == n - 1 else (a >> (bits * i)) & low).astype(np.float64) for i in range(n)]


def exact_product(a, b):
    """a @ b of int64 matrices, exact where the product fits int64. Sums of products of limbs stay within 2^53."""
    bits = (53 - math.ceil(math.log2(max(2, a.shape[1])))) // 2
    out = np.zeros((a.shape[0], b.shape[1]), np.int64)
    right = limbs(b, bits)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(right):
            if bits * (i + j) < 64:  # what is beyond is a multiple of 2^64
                out += (x @ y).astype(np.int64) << np.int64(bits * (i + j))
    return out


def integers(vectors, scale: int):
    """floor(scale * x) of a float64 matrix, int64 or, where that is too small, Python's integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * vectors)
    if not scaled.size or np.abs(scaled).max() < 1 << 62:
        return scaled.astype(np.int64)
    whole = [int(x) * scale if abs(x) >= 1 << 53 else int(s) for x, s in zip(vectors.ravel().tolist(), scaled.ravel().tolist())]
    return np.array(whole, object).reshape(vectors.shape)


def nearest_entries(points, book):
    """(index, squared distance) of the first nearest entry for each row of points; int64, or objects where that is needed."""
    reach = _most(points) + _most(book)
    if points.shape[1] * reach * reach >= 1 << 62:
        apart = ((points.astype(object)[:, None, :] - book.astype(object)[None, :, :]) ** 2).sum(axis=2)
    else:
        points, book = points.astype(np.int64), book.astype(np.int64)
        apart = (points * points).sum(axis=1)[:, None] - 2 * exact_product(points, np.ascontiguousarray(book.T)) + (book * book).sum(axis=1)[None, :]
    at = apart.argmin(axis=1)  # the first of the least
    return at, apart[np.arange(len(points)), at]


def part_sums(points, at, entries: int):
    """(sums, counts) of the rows of each entry, as Python's integers; a product with the matrix of assignments."""
    own = np.zeros((entries, len(points)), np.int64)
    own[at, np.arange(len(points))] = 1
    if _most(points) * len(points) >= 1 << 62:
        sums = own.astype(object) @ points.astype(object)
    else:
        sums = exact_product(own, points.astype(np.int64)).astype(object)
    return sums, own.sum(axis=1).astype(object)


def digits(value: int):
    """(place, digit) with value = sum of digit * 2^(DIGIT * place), digits below 2^DIGIT in size."""
    place = 0
    while abs(value) >> DIGIT:
        yield place, value & ((1 << DIGIT) - 1)
        value, place = value >> DIGIT, place + 1
    yield place, value


def _matrices(batches, dim: int, scale: int):
    """(frame, mask, integers of its rows under the mask: those with dim components) for each batch."""
    for pdf in batches:
        if len(pdf):
            right = pdf["vector"].map(len).to_numpy() == dim
            found = np.stack(pdf["vector"][right]).astype(np.float64) if right.any() else np.zeros((0, dim))
            yield pdf, right, integers(found, scale)


def sound(vector: str) -> Column:
    """True for vectors that are not null and hold finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list:
    """Codebooks, one integer matrix for each part, of rows (id, vector), which is read once for each round."""
    first = rows.where((F.size("vector") > 0) & (F.size("vector") % parts == 0)).orderBy(F.col("id").asc_nulls_last(), "vector")
    head = first.select(F.size("vector").alias("n")).first()
    if head is None:
        return []
    dim = head["n"]
    begin = [r["vector"] for r in rows.where(F.size("vector") == dim).orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()]
    books = np.split(integers(np.array(begin, np.float64), scale), parts, axis=1)
    for _ in range(rounds):
        books = _refined(rows, books, scale)
    return books


def _refined(rows: DataFrame, books: list, scale: int) -> list:
    """The codebooks after one round."""
    parts, entries, width = len(books), *books[0].shape

    def summed(batches):
        import pandas as pd

        total = np.zeros((parts, entries, width + 1), object)
        for _, _, whole in _matrices(batches, parts * width, scale):
            for p, (points, book) in enumerate(zip(np.split(whole, parts, axis=1), books)):
                sums, counts = part_sums(points, nearest_entries(points, book)[0], entries)
                total[p, :, :width] += sums
                total[p, :, width] += counts
        out = [(p, e, t, place, d) for (p, e, t), v in np.ndenumerate(total) if v for place, d in digits(v)]
        yield pd.DataFrame(out, columns=["part", "entry", "at", "place", "digit"]).astype("int64")

    sums = rows.select("vector").mapInPandas(summed, "part int, entry int, at int, place int, digit long")
    found = np.zeros((parts, entries, width + 1), object)
    for r in sums.groupBy("part", "entry", "at", "place").agg(F.sum("digit").alias("digit")).collect():  # as many as the codebooks have numbers
        found[r["part"], r["entry"], r["at"]] += r["digit"] << (DIGIT * r["place"])
    after = []
    for book, sums in zip(books, found):
        new = [[s // n for s in row] if n else old for *row, n, old in ((*r, o) for r, o in zip(sums.tolist(), book.tolist()))]
        fits = all(abs(x) < 1 << 62 for row in new for x in row)
        after.append(np.array(new, np.int64 if fits else object))
    return after


def encode(rows: DataFrame, books: list, scale: int = SCALE) -> DataFrame:
    """The columns of rows but vector, with code (two hex digits for each part) and error."""
    parts, width = len(books), books[0].shape[1] if books else 0
    carried = [f for f in rows.schema.fields if f.name != "vector"]

    def coded(batches):
        for pdf, right, whole in _matrices(batches, parts * width, scale):
            code, error = np.full(len(pdf), None, object), np.full(len(pdf), None, object)
            if books and right.any():
                names, total = np.zeros((len(whole), parts), np.uint8), np.zeros(len(whole), object)
                for p, (points, book) in enumerate(zip(np.split(whole, parts, axis=1), books)):
                    at, apart = nearest_entries(points, book)
                    names[:, p] = at
                    total += apart.astype(object)
                code[right] = [n.tobytes().hex() for n in names]
                error[right] = [x if x <= LONG else None for x in total.tolist()]
            out = pdf.drop(columns="vector").assign(code=code)
            out["error"] = error
            yield out.astype({"error": "Int64"})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carried), "code string", "error long"])
    return rows.mapInPandas(coded, schema)


def books_digest(books: list) -> str:
    """SHA-256 of all components, by part, entry and place within the part, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for row in book.tolist() for x in row).encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, list]:
    """(vec_id, label, code, error, label_error of each row that takes part; the codebooks)."""
    rows = fresh(vectors, vec_id, vector, label).toDF("id", "vector", "label").where(sound("vector"))
    rows = written(rows, "vectors")
    books = train(rows.select("id", "vector"))
    coded = written(encode(rows, books), "codes")
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of")
    found = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return found.select(F.col("id").alias("vec_id"), "label", "code", "error", "label_error"), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = compress(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds as one common table expression after the other."""
    steps = [
        "k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT r, (j - 1) // (n // {PARTS}) AS p, (j - 1) % (n // {PARTS}) AS t, CAST(floor({SCALE} * CAST(embedding[j] AS DOUBLE)) AS BIGINT) AS v FROM (SELECT r, embedding, len(embedding) AS n, unnest(range(1, len(embedding) + 1)) AS j FROM k))",
        f"c0 AS MATERIALIZED (SELECT p, r - 1 AS e, t, v FROM x WHERE r <= {ENTRIES})",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"d{i} AS MATERIALIZED (SELECT x.r, x.p, c.e, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{i} AS c USING (p, t) GROUP BY ALL)")
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, p, arg_min(e, d * {ENTRIES} + e) AS e, min(d) AS d FROM d{i} GROUP BY ALL)")
        if i < ROUNDS:
            steps.append(f"s{i} AS (SELECT x.p, a.e, x.t, sum(x.v) AS s, count(*) AS n FROM x JOIN a{i} AS a USING (r, p) GROUP BY ALL)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, c.t, CASE WHEN n IS NULL THEN c.v ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS v FROM c{i} AS c LEFT JOIN s{i} USING (p, e, t))")
    steps.append(f"f AS MATERIALIZED (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)")
    steps.append(f"h AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, t)) AS codebooks_sha256 FROM c{ROUNDS})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN f USING (r), h"


QUERIES = {"op13_vector_codes": op13_vector_codes}
ORACLE_SQL = {"op13_vector_codes": _sql()}
