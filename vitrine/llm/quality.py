"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a Column that is true where a document is rejected. On a bounded sample, drawn from all partitions, the
cascade measures every rule's cost (many evaluations, less what a run without a rule takes) and the share that it
rejects, orders the rules by rejection per cost, and folds them into one CASE: a document that a rule rejects is never
tried against the rules after it. The order changes the work, never the verdict.

Defined cases: null text has no words and fails the base rules; a rule that gives null does not reject; repeated rows
are judged alike; empty tables give empty ones; other columns of the input pass through whatever their names, but for those
that are called like a result, which takes their place.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import WORD, fresh, table

#: Rows of the sample on which costs and selectivities are estimated, about; and how often a rule is evaluated on each.
SAMPLE_ROWS, EVALUATIONS = 2000, 20
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[^#*$%&|<>]+"
N = 5


def base_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines and n_repeat_words to docs.

    n_repeat_words sorts the hashes of the 5-word windows within the row, so that it needs no shuffle; windows whose
    hashes meet are compared again by their words."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_words", F.array_remove(F.split(t, SPACE), ""))
    df = df.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    word = lambda i: F.get("_words", i.cast("int"))
    hashed = F.transform(F.sequence(F.lit(0), F.col("n_words") - N), lambda i: F.xxhash64(*(word(i + j) for j in range(N))))
    df = df.withColumn("_grams", F.when(F.col("n_words") >= N, hashed))
    df = df.withColumn("_again", F.size(F.array_distinct("_grams")) < F.size("_grams"))
    pairs = F.array_sort(F.transform("_grams", lambda h, i: F.struct(h.alias("g"), i.alias("at"))))
    df = df.withColumn("_sorted", F.when(F.col("_again"), pairs))
    df = df.withColumn("_met", _neighbours("_sorted"))
    exact = F.transform("_met", lambda x: F.struct(F.array_join(F.slice(F.col("_words"), x["at"] + 1, N), " ").alias("g"), x["at"].alias("at")))
    df = df.withColumn("_exact", F.array_sort(exact))
    df = df.withColumn("_starts", F.array_sort(F.transform(_neighbours("_exact"), lambda x: x["at"])))
    covered = F.transform("_starts", lambda p, i: F.least(F.lit(N), F.coalesce(F.get("_starts", i + 1) - p, F.lit(N))))
    return df.withColumns(
        {
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(t, SYMBOLS, "")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
        }
    ).drop("_words", "_lines", "_grams", "_again", "_sorted", "_met", "_exact", "_starts")


def _neighbours(name: str) -> Column:
    """Elements of a sorted array whose g equals that of the one before or after."""
    same = lambda x, y: F.coalesce(x["g"] == y["g"], F.lit(False))
    return F.filter(name, lambda x, i: same(x, F.get(name, i + 1)) | same(x, F.get(name, i - 1)))


def default_rules(text: str = "text") -> dict[str, Column]:
    """Rejections beyond the base rules; they read the base features and the text."""
    n, t = F.col("n_words"), F.col(text)
    return {
        "many_symbols": 10 * F.col("n_symbols") > 3 * n,
        "repeated_lines": (F.col("n_dup_lines") > 1) & (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        "odd_word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
        "shouting": 10 * F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")) > 6 * F.length(F.regexp_replace(t, r"[^\p{L}]+", "")),
        "few_letters": 10 * F.length(F.regexp_replace(t, r"[^\p{L}]+", "")) < 4 * F.col("word_chars"),
    }


def cascade_order(docs: DataFrame, rules: dict[str, Column], sample_rows: int = SAMPLE_ROWS, text: str = "text") -> list[str]:
    """Names of rules, those with the most rejections per second on the sample first; ties by name. Features are computed for
    the sample's rows alone: it is drawn from the texts as they are read."""
    total = docs.count()
    sample = base_features(docs.select(text).sample(min(1.0, sample_rows / max(total, 1)), 1), text).cache()
    shares = sample.agg(F.count("*").alias("_n"), *(F.count_if(r).alias(k) for k, r in rules.items())).first()
    many = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(EVALUATIONS))))

    def seconds(rule: Column) -> float:
        took = []
        for _ in range(2):
            began = time.perf_counter()
            many.agg(F.count_if(rule)).first()
            took.append(time.perf_counter() - began)
        return min(took)

    empty = seconds(F.col("_again") < 0)
    rate = {k: shares[k] / max(shares["_n"], 1) / max(seconds(r) - empty, 1e-4) for k, r in rules.items()}
    sample.unpersist()
    return sorted(rules, key=lambda k: (-rate[k], k))


def cascade(rules: dict[str, Column], order: list[str]) -> Column:
    """True where no rule rejects; a rule is evaluated only where those before it have not rejected."""
    kept = F.lit(True)
    for k in reversed(order):
        kept = F.when(rules[k], False).otherwise(kept)
    return kept


#: What quality_verdicts adds.
RESULTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_verdicts(docs: DataFrame, rules: dict[str, Column] | None = None, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with the base features, base_failed and kept."""
    rules = default_rules(text) if rules is None else rules
    order = cascade_order(docs, rules, sample_rows, text)
    others = [c for c in docs.columns if c not in RESULTS]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("_row"), F.col(f"`{text}`"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    df = base_features(rows, text).withColumn("base_failed", failed)
    df = df.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(cascade(rules, order)))
    return df.select(*(F.col(f"_row.`{c}`").alias(c) for c in others), *RESULTS)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_verdicts(fresh(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op6_quality": op6_quality}
ORACLE_SQL = {
    "op6_quality": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g, len(w) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
f AS (
  SELECT doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
    length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS upper, length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS letters
  FROM d LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR (n_dup_lines > 1 AND 10 * n_dup_lines > 3 * n_lines) OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 10 * upper > 6 * letters OR 10 * letters < 4 * word_chars) AS kept
FROM b"""
}
