"""A training corpus from raw documents: toxicity, near-duplicates, repeated passages, mixing and tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it has written. All but the last return
the columns of docs. doc_id is the key of a document. For all stages: an empty table gives an empty one, texts of any length
are worked on whole, nulls in other columns stay as they are, and other columns pass through whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import bpe, mixing, near, suffix_dedup, toxicity
from vitrine.llm.common import new_folder, table


def _as_one(docs: DataFrame) -> DataFrame:
    """docs as a single column row, so that no name of theirs meets one that a stage adds."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows whose severity grade is over 0; null text is empty, and each row is graded by its own text."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = _as_one(docs).withColumn("severity", toxicity.scores(spark, model, F.col("row.text")))
    return scored.where(~F.col("severity.toxic")).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row, by doc_id, of each group of five-word similarity 0.8; rows without a doc_id come last, and rows that
    repeat one are documents of their own."""
    return near.drop_near_copies(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated byte strings go, the first stays; n_chars follows the text. Null text becomes empty, each row
    is a document of its own."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    found = suffix_dedup.remove_repeats(docs, keep_first=True, as_text=True, carry=others)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return found.select(*(new.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, by shard, in pieces that are each in the shard's own order.
    Where a source's target ends within a document, its last draw holds the words up to there. Draws reach their rows by a
    key made for each row, written down before: rows without a doc_id and rows that repeat one are documents of their own."""
    path = new_folder(spark, "mixing-rows")
    _as_one(docs).withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    keyed = spark.read.parquet(path)
    names = ("doc_id", "text", "source")
    drawn = mixing.mix(keyed.select("at", *(F.col(f"row.{c}").alias(c) for c in names)), carry=("at",)).select("at", "size", F.explode("draws").alias("draw"))
    rows = keyed.join(drawn, "at")
    words = F.array_remove(F.split("row.text", r"[\x20\x09-\x0D]+"), "")
    whole = F.col("draw.words") >= F.col("size")
    text = F.when(whole, F.col("row.text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("draw.words"), F.lit(1)).cast("int")), " "))
    rows = rows.withColumn("text", text)
    pieces = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // mixing.SHARDS)  # tasks for each shard
    rows = rows.repartition("draw.shard", F.pmod("draw.place", F.lit(pieces))).sortWithinPartitions("draw.shard", "draw.place")
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded bytes, a row for each row of docs; null text is empty."""
    return bpe.encode_digests(docs, *bpe.default_ranks())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeats),
    ("source_mixing", mix_sources),
    ("byte_bpe", tokenize),
]

#: SQL has neither the fitted model nor XXH64 nor the tokenizer; tests/llm checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
