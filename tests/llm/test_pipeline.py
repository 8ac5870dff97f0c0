"""The pipeline's stages on the smallest tables: each against what its operator says, and the whole run."""

import corpus_pipeline as p
from tests.llm.test_near import heads, pairs
from vitrine.llm import suffix_dedup, toxicity
from vitrine.llm.common import new_folder


def test_stages(spark, sf):
    from pyspark.sql import functions as F

    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in p.STAGES:
        before = docs
        out = stage(spark, docs, sf)
        path = new_folder(spark, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append((name, docs.count()))
        if name != "byte_bpe":
            assert docs.columns == before.columns
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{sf}/labels.parquet"))
            toxic = before.where(toxicity.scores(spark, model, F.col("text"))["toxic"])
            assert docs.count() == before.count() - toxic.count() and docs.join(toxic, "doc_id").count() == 0
        if name == "simhash_near_dedup":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted({*heads(rows, pairs(rows)).values()})
        if name == "suffix_array_dedup":
            want = {r["doc_id"]: r["kept"] for r in suffix_dedup.remove_repeats(before, as_text=True).collect()}
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == want
        if name == "source_mixing":
            assert {r["doc_id"] for r in docs.collect()} <= {r["doc_id"] for r in before.collect()}
        if name == "byte_bpe":
            import hashlib

            want = sorted((str(r["doc_id"]), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in before.collect())
            assert sorted((str(r["doc_id"]), r["decoded_sha256"]) for r in docs.collect()) == want
    assert [n for n, _ in seen] == [n for n, _ in p.STAGES]


def test_nulls_and_empty_tables(spark, tmp_path):
    from tests.llm.cases import DOC, documents

    spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (documents(4, 30) + [(None, "no id", None, None, None)], []):
        docs = spark.createDataFrame(rows, DOC)
        for _, stage in p.STAGES:
            path = new_folder(spark, "stage")
            stage(spark, docs, str(tmp_path)).write.parquet(path)
            docs = spark.read.parquet(path)
        assert (docs.count() > 0) == bool(rows)


def test_other_columns_pass_whatever_their_names(spark, tmp_path):
    """Columns with the names that stages and operators use inside keep their values."""
    from pyspark.sql import functions as F

    from tests.llm.cases import DOC, documents

    spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names = ("row", "at", "severity", "draw", "draws", "size", "target", "src", "block", "part", "key", "keys", "doc", "cid", "spans", "carried", "kept", "__row", "__toxicity", "_row", "word", "t", "a.b")
    docs = spark.createDataFrame(documents(5, 40), DOC).withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    columns, before = docs.columns, docs.count()
    for name, stage in p.STAGES[:-1]:
        path = new_folder(spark, name)
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns and 0 < docs.count() <= 4 * before
        for n in names:
            assert docs.where(F.col(f"`{n}`") != F.concat(F.lit(n), F.col("doc_id").cast("string"))).count() == 0, (name, n)
    tokens = p.STAGES[-1][1](spark, docs, str(tmp_path))
    assert tokens.count() == docs.count()
