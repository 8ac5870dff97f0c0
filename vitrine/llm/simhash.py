"""SimHash near-duplicate groups: BK-trees over bounded shards of the distinct fingerprints.

Three blocks of the 64 bits make the shards: fingerprints at two or fewer differing bits agree in at least one of
three blocks. A shard over SHARD_CAP is divided again by three blocks of its bits that are still free, down to
SHARD_LEVELS levels, where at most 2**10 fingerprints can differ; so every tree has a proven size bound and no link is
lost. Each shard's tree holds children by integer Hamming distance to the parent; a query follows the edges within the
radius only. Trees reach their queries by the shuffle on the shard, since all trees together grow with the corpus. A
shard gives a spanning forest of its links, never all pairs; components then come from star contraction.

Defined cases: a null or empty text, or one without words, has fingerprint zero; equal fingerprints are one node; rows
that repeat a doc_id give a row each, linked by their own fingerprints; rows without a doc_id are linked like any other and
have a null component only if no document of their component has a doc_id. Other columns of the input are not looked at.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import checkpointed, fresh, groups, table

SHARD_CAP = 512
SHARD_LEVELS = 5
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the lower-cased (A-Z) word shingles, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    h, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < shingle:
        hashes = np.array([h(join(words), 42)], dtype=np.uint64)
    else:
        n = len(words) - shingle + 1
        hashes = np.fromiter((h(join(w), 42) for w in zip(*(words[i:] for i in range(shingle)))), np.uint64, n)
    return majority(hashes)


def majority(hashes) -> int:
    """Unsigned 64-bit number whose bits are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


class BKTree:
    """Integers by Hamming distance; children are keyed by their distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        new = len(self.values)
        if new:
            at = 0
            while True:
                d = (self.values[at] ^ value).bit_count()
                if d == 0:
                    return at
                if d not in self.children[at]:
                    self.children[at][d] = new
                    break
                at = self.children[at][d]
        self.values.append(value)
        self.children.append({})
        return new

    def near(self, value: int, radius: int):
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            stack += [c for e, c in self.children[at].items() if d - radius <= e <= d + radius]


def shard_links(values, names, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct values, as pairs of names."""
    tree, root, out = BKTree(), list(range(len(values))), []

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, v in enumerate(values):
        for j in tree.near(v, radius):
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                out.append((names[i], names[j]))
        tree.add(v)
    return out


def _blocks(free: list[int], n: int) -> list[list[int]]:
    cut = [len(free) * i // n for i in range(n + 1)]
    return [free[cut[i] : cut[i + 1]] for i in range(n)]


def _paths(level: int, n: int) -> list[tuple[int, list[int]]]:
    """(path, free bits) of every way to have fixed level blocks."""
    found = [(0, list(range(64)))]
    for _ in range(level):
        found = [(p * n + b, [x for x in free if x not in block]) for p, free in found for b, block in enumerate(_blocks(free, n))]
    return found


def _signed(bits) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) of nodes (fp long, distinct; name long): a spanning forest per shard."""
    spark, n, found = nodes.sparkSession, radius + 1, None
    members = nodes.select(F.lit(0).alias("path"), F.lit(0).cast("long").alias("shard"), "fp", "name")

    def search(batches):
        import pandas as pd

        for _, g in groups(batches, "shard"):
            pairs = shard_links(g["fp"].view(np.uint64).tolist(), g["name"].tolist(), radius)
            if pairs:
                yield pd.DataFrame(pairs, columns=["a", "b"])

    for level in range(SHARD_LEVELS):
        rules = spark.createDataFrame(
            [(p, p * n + b, _signed(block)) for p, free in _paths(level, n) for b, block in enumerate(_blocks(free, n))], "path int, child int, mask long"
        )  # n ** (level + 1) rows, whatever the input
        members = members.join(F.broadcast(rules), "path").select(
            F.col("child").alias("path"), F.xxhash64("shard", "child", F.col("fp").bitwiseAND(F.col("mask"))).alias("shard"), "fp", "name"
        )
        sizes = members.groupBy("shard").agg(F.count("*").alias("size")).where("size > 1")
        members = checkpointed(members.join(sizes, "shard"))
        last = level == SHARD_LEVELS - 1
        small = members if last else members.where(F.col("size") <= SHARD_CAP)
        part = small.select("shard", "fp", "name").repartition("shard").sortWithinPartitions("shard").mapInPandas(search, "a long, b long")
        found = part if found is None else found.unionByName(part)
        members = members.where(F.col("size") > SHARD_CAP).drop("size")
        if last or not members.take(1):
            break
    return found


def components(edges: DataFrame) -> DataFrame:
    """(name, component): the least name reachable, for every name in edges (a, b), by alternating star contraction."""
    stars = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        stars = checkpointed(small)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return stars.select(F.col("u").alias("name"), F.col("v").alias("component"))
        before = now


def simhash_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp (signed long), component_id for each row of docs."""

    def prints(batches):
        for pdf in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in pdf["t"]), np.uint64, len(pdf)).view(np.int64)
            yield pdf[["doc_id"]].assign(fp=fp)

    read = fresh(docs, doc_id, text).toDF("doc_id", "t")
    fp = checkpointed(read.mapInPandas(prints, "doc_id long, fp long"))
    classes = fp.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(classes.select("fp", F.col("fp").alias("name")), radius)).withColumnRenamed("name", "fp")
    classes = classes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    return fp.join(classes.join(ids, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
ORACLE_SQL: dict[str, str] = {}
