"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions only.

Sources get targets by weight, none over MAX_REPEATS times its size. Each source's documents, permuted by a seeded
hash, fall into BLOCKS blocks; a source gives every block floor(target / size) times, and once more the first blocks of
the permutation, as far as the target asks for. The block where the target ends is divided the same way by a finer hash,
and in its last cell by document, where the last document gives only its first words. A splitting tree then deals each
source's exact number of blocks to the output shards: each node splits the counts of all sources between its halves by a
multivariate-hypergeometric draw, down to the leaves. Which blocks a shard gets follows from a second permutation;
within a shard, rows are ordered by a hash.

The driver sees one row for each source and no more. Windows run over the blocks of a source, their number being fixed,
or over the documents of one cell of 1 / (BLOCKS * CELLS) of a source.

Defined cases: null text has size 0 and is never drawn; a null source is a source, the last; a null doc_id is permuted
as a value of its own; rows that repeat a doc_id share its place and are drawn as documents of their own; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.llm.common import checkpointed, fresh, table

MAX_REPEATS = 3
BLOCKS, CELLS = 256, 4096
SHARDS = 16
SEED = 20


def sizes(text: str = "text") -> Column:
    words = F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), ""))
    return words.cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, src (its number from 1), source_size, target, copies and part (words beyond the whole copies).

    A source is held at its limit if, with all sources before it in the order of limit per weight at theirs, its share
    would be above the limit."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    cycle = F.array(*map(F.lit, weights))
    df = by_source.withColumn("src", F.row_number().over(order)).withColumn("w", F.element_at(cycle, ((F.col("src") - 1) % len(weights) + 1).cast("int")).cast("long"))
    df = df.withColumn("limit", MAX_REPEATS * F.col("source_size"))
    every = Window.partitionBy()
    by_limit = Window.orderBy(F.col("limit") / F.col("w"), "src")
    df = df.withColumn("total", F.sum("source_size").over(every))
    df = df.withColumn("held_before", F.coalesce(F.sum("limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    df = df.withColumn("w_left", F.sum("w").over(by_limit.rowsBetween(0, Window.unboundedFollowing)))
    df = df.withColumn("held", (F.col("total") - F.col("held_before")) * F.col("w") >= F.col("limit") * F.col("w_left"))
    held = F.coalesce(F.sum(F.when(F.col("held"), F.col("limit"))).over(every), F.lit(0))
    free = F.sum(F.when(~F.col("held"), F.col("w"))).over(every)
    share = (F.col("total") - held).cast("double") * F.col("w") / free
    df = df.withColumn("target", F.when(F.col("held"), F.col("limit").cast("double")).otherwise(share))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    df = df.withColumn("copies", F.least(whole, F.lit(MAX_REPEATS).cast("long")))
    part = F.greatest(F.lit(0), F.round("target").cast("long") - F.col("copies") * F.col("source_size"))
    return df.select("source", "src", "source_size", "target", "copies", part.cast("long").alias("part"))


def hypergeometric(rng: random.Random, counts: list[int], taken: int) -> list[int]:
    """How many of each colour are among taken units drawn without replacement."""
    left, out = sum(counts), []
    for c in counts:
        got = 0
        for _ in range(c):
            if rng.random() * left < taken:
                got += 1
                taken -= 1
            left -= 1
        out.append(got)
    return out


def splitting_tree(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """For each shard the units of each source; columns add up to counts, and shards differ by one unit at most."""

    def split(node: list[int], lo: int, hi: int) -> list[list[int]]:
        if hi - lo == 1:
            return [node]
        mid = (lo + hi) // 2
        taken = total[mid] - total[lo]
        one = hypergeometric(random.Random(f"{seed}/{lo}/{hi}"), node, taken)
        return split(one, lo, mid) + split([a - b for a, b in zip(node, one)], mid, hi)

    n = sum(counts)
    total = [n * i // shards for i in range(shards + 1)]
    return split(list(counts), 0, shards)


def _before(column: str, *order) -> Column:
    w = Window.partitionBy("src").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(w), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), shards: int = SHARDS, seed: int = SEED, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, draws and the columns carry for each row of docs; draws is an array of structs of words,
    shard and place (rows of a shard are ordered by place), one for each time that the mix takes the document."""
    spark = docs.sparkSession
    sized = fresh(docs, "doc_id", "source", text, *carry).select("doc_id", "source", sizes(text).alias("size"), *carry)
    h = F.xxhash64(F.lit(seed), "doc_id")
    sized = checkpointed(
        sized.select("*", h.alias("h"), F.shiftrightunsigned(h, 56).cast("int").alias("block"), F.shiftrightunsigned(h, 44).bitwiseAND(F.lit(CELLS - 1)).cast("int").alias("cell"))
    )
    plan = checkpointed(targets(sized, weights))
    rows = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).drop(plan["source"])

    # blocks in the order of the permutation: whole below the quota, and one in which it ends
    blocks = rows.groupBy("src", "block").agg(F.sum("size").alias("words"), F.first("copies").alias("copies"), F.first("part").alias("part"))
    blocks = blocks.withColumn("left", F.col("part") - _before("words", "block"))
    blocks = checkpointed(blocks.withColumn("more", (F.col("left") > 0).cast("int")))
    ends = blocks.where("left > 0 and left < words").select("src", "block", "left")
    inside = rows.select("doc_id", "size", "src", "block", "cell", "h").join(ends, ["src", "block"])
    cells = inside.groupBy("src", "block", "cell").agg(F.sum("size").alias("words"), F.first("left").alias("block_left"))
    cells = cells.withColumn("left", F.col("block_left") - _before("words", "cell")).select("src", "block", "cell", F.col("left").alias("cell_left"), "words")

    # the tree deals each source's drawn blocks to shards
    n_units = F.col("copies").cast("int") + F.col("more")
    units = blocks.where(n_units > 0).select("src", "block", F.explode(F.sequence(F.lit(0), n_units - 1)).alias("copy"))
    counts = {x["src"]: x["n"] for x in units.groupBy("src").agg(F.count("*").alias("n")).collect()}  # a row for each source
    order = sorted(counts)
    dealt, first = [], dict.fromkeys(order, 0)
    for shard, got in enumerate(splitting_tree([counts[s] for s in order], shards, seed)):
        for s, n in zip(order, got):
            if n:
                dealt.append((s, shard, first[s], first[s] + n))
                first[s] += n
    ranges = spark.createDataFrame(dealt, "src int, shard int, lo int, hi int")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed + 1), "src", "block", "copy"), "block", "copy")) - 1
    placed = units.withColumn("rank", rank).join(ranges, "src").where("rank >= lo and rank < hi")
    drawn = placed.groupBy("src", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("units"))

    # each document: whole copies, and what the last copy takes of it
    rows = rows.join(cells.select("src", "block", "cell", "cell_left", F.col("words").alias("cell_words")), ["src", "block", "cell"], "left")
    ends_here = F.coalesce((F.col("cell_left") > 0) & (F.col("cell_left") < F.col("cell_words")), F.lit(False))
    rows = rows.where(~ends_here).withColumn("rest", F.lit(0).cast("long")).unionByName(
        rows.where(ends_here).withColumn("rest", F.col("cell_left") - _before("size", "h", "doc_id", "size", *carry))
    )
    rows = rows.join(blocks.select("src", "block", "left", "words"), ["src", "block"]).join(drawn, ["src", "block"], "left")
    extra = (
        F.when(F.col("left") <= 0, F.lit(0))
        .when(F.col("left") >= F.col("words"), F.col("size"))
        .when(F.col("cell_left") <= 0, F.lit(0))
        .when(F.col("cell_left") >= F.col("cell_words"), F.col("size"))
        .otherwise(F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest"))))
    ).cast("long")
    rows = rows.withColumn("extra", extra)
    words = lambda u: F.when(u["copy"] < F.col("copies"), F.col("size")).otherwise(F.col("extra"))
    place = lambda u: F.xxhash64(F.lit(seed + 2), "doc_id", u["copy"])
    draws = F.transform(F.coalesce("units", F.array().cast("array<struct<copy:int,shard:int>>")), lambda u: F.struct(words(u).alias("words"), u["shard"].alias("shard"), place(u).alias("place")))
    return rows.select("doc_id", "source", "size", "source_size", "target", F.filter(draws, lambda x: x["words"] > 0).alias("draws"), *carry)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return found.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


QUERIES = {"op9_mixing": op9_mixing}
ORACLE_SQL: dict[str, str] = {}
