"""Toxicity by cumulative-link ordinal regression over sparse text features.

Grades: 0 for a clean document, 1 and 2 for a toxic one with few or many of the words that mark toxic documents (at most,
or over, the median of toxic documents in the sample); labels give toxic only as 0 or 1. The model has one weight for each
word, shared by all thresholds: P(grade > k) = sigmoid(x w - threshold_k) with rising thresholds, where x holds
log(1 + count) of the vocabulary's words and stems. A document's expected severity is the sum of P(grade > k); its grade is the
number of thresholds that it passes with P >= 0.5, and it is toxic from grade 1 on.

The model is fitted on at most SAMPLE_DOCS labelled documents (a parameter), those whose ids hash lowest. Spark counts their
words and picks the telling ones; only these, and their counts in the sample, come to the driver. Scoring reads every
document whole.

Defined cases: null or empty text has no features and takes the grade of the thresholds alone; labels that are null or of
documents that are not there are left out, and of a doc_id's labels the largest counts; without any toxic label, or any
telling word, nothing is toxic; rows that repeat a doc_id, or have none, are scored by their own texts, and in the sample
the least text of a doc_id stands for it; words are the runs between ASCII punctuation, digits and blanks, A-Z lower-cased.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import log1p

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import checkpointed, table

SAMPLE_DOCS = 6000
#: A telling word is in at least MIN_DOCS documents of the sample, and its share of toxic documents differs from
#: its share of the others by MIN_Z standard errors at least: labels hold noise, which rare words would learn by heart.
MIN_DOCS, MIN_Z = 4, 4.0
PREFIX = 6
STEPS, RATE, RIDGE = 300, 0.1, 2e-5
TO_SPACE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().translate(TO_SPACE).split()


def features(text: str | None) -> list[bytes]:
    """The words of a text, and the first PREFIX bytes of its longer words: stems recur where whole words are too rare."""
    found = words(text)
    return found + [w[:PREFIX] + b"*" for w in found if len(w) > PREFIX]


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    weights: dict[bytes, float]
    thresholds: list[float]

    def eta(self, text: str | None) -> float:
        known = self.weights
        return sum(known[w] * log1p(n) for w, n in Counter(w for w in features(text) if w in known).items())

    def above(self, etas):
        """P(grade > k), a column for each k."""
        return sigmoid(np.asarray(etas, float)[:, None] - np.asarray(self.thresholds)[None, :])


#: The model where nothing tells toxic documents from others.
NOTHING = Model({}, [50.0, 51.0])


def unpacked(p, n_words: int):
    """Weights, rising thresholds and their gaps, of parameters: weights, first threshold, logarithms of the gaps."""
    gaps = np.exp(p[n_words + 1 :])
    return p[:n_words], np.concatenate([p[n_words : n_words + 1], p[n_words] + np.cumsum(gaps)]), gaps


def loss(p, y, at, col, val, n_words: int):
    """Mean ordinal log loss with a ridge on the weights, and its gradient by the parameters.

    Document i has the grade y[i]; its features are those entries of (col, val) whose at is i."""
    w, theta, gaps = unpacked(p, n_words)
    n, k = len(y), len(theta)
    eta = np.bincount(at, w[col] * val, n)
    upper = np.concatenate([np.ones((n, 1)), sigmoid(eta[:, None] - theta[None, :]), np.zeros((n, 1))], axis=1)
    a, b = upper[np.arange(n), y], upper[np.arange(n), y + 1]
    like = np.maximum(a - b, 1e-9)
    da, db = a * (1 - a) / like, b * (1 - b) / like  # of log likelihood by eta, through either bound
    g_eta = -(da - db) / max(n, 1)
    g_theta = np.array([(da[y == j + 1].sum() - db[y == j].sum()) / max(n, 1) for j in range(k)])
    by_gap = [g_theta[j + 1 :].sum() * gaps[j] for j in range(k - 1)]
    gradient = np.concatenate([np.bincount(col, g_eta[at] * val, n_words) + RIDGE * w, [g_theta.sum()], by_gap])
    return -np.log(like).sum() / max(n, 1) + RIDGE / 2 * (w @ w), gradient


def fit_rows(rows: list[tuple[list[int], list[float]]], grades, n_words: int, n_grades: int = 3, steps: int = STEPS):
    """Weights and rising thresholds that minimise the loss (Adam, full batches)."""
    y = np.asarray(grades)
    at = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    col = np.concatenate([np.asarray(i, np.int64) for i, _ in rows] or [np.zeros(0, np.int64)])
    val = np.concatenate([np.asarray(v, float) for _, v in rows] or [np.zeros(0)])
    share = np.clip([(y > j).mean() if len(y) else 0 for j in range(n_grades - 1)], 1e-4, 1 - 1e-4)
    start = np.log((1 - share) / share)
    p = np.concatenate([np.zeros(n_words), start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        _, g = loss(p, y, at, col, val, n_words)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights, theta, _ = unpacked(p, n_words)
    return weights, theta.tolist()


def _document_counts(rows, toxic, n_words: int):
    """How many clean (0) and toxic (1) documents hold each word."""
    df = np.zeros((2, n_words))
    for (cols, _), t in zip(rows, toxic):
        df[int(t), cols] += 1
    return df


def telling(words: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """Of words (word, label: a row for each document that holds it), those in MIN_DOCS documents at least whose share of
    toxic documents differs from their share of others by MIN_Z standard errors."""
    counts = words.groupBy("word").agg(F.count_if(F.col("label") > 0).alias("d1"), F.count_if(F.col("label") <= 0).alias("d0")).where(f"d1 + d0 >= {MIN_DOCS}")
    n1, n0 = max(n_toxic, 1), max(n_clean, 1)
    share = (F.col("d1") + F.col("d0")) / max(n_toxic + n_clean, 1)
    error = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / n1 + 1 / n0))
    return counts.where(F.abs(F.col("d1") / n1 - F.col("d0") / n0) >= MIN_Z * error).select("word")


def grade_of(rows, toxic, n_words: int) -> list[int]:
    """Toxic documents by their number of marking words: those with a log-odds over 2."""
    toxic = np.asarray(toxic, bool)
    df = _document_counts(rows, toxic, n_words)
    odds = np.log((df[1] + 0.5) / (toxic.sum() + 1)) - np.log((df[0] + 0.5) / ((~toxic).sum() + 1))
    marks = odds > 2
    hits = np.array([sum(np.expm1(v) for c, v in zip(cols, vals) if marks[c]) for cols, vals in rows])
    middle = np.median(hits[toxic]) if toxic.any() else 0
    return [0 if not t else 2 if h > middle else 1 for t, h in zip(toxic, hits)]


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """The model of at most sample_docs labelled documents."""
    picked = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)

    def counted(batches):
        import pandas as pd

        for pdf in batches:
            found = [Counter(features(t)) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "words": [list(c) for c in found], "n": [list(c.values()) for c in found]})

    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    sample = checkpointed(sample.mapInPandas(counted, "doc_id long, label int, words array<binary>, n array<int>"))
    n_toxic, n_clean = sample.agg(F.count_if(F.col("label") > 0), F.count_if(F.col("label") <= 0)).first()
    if not n_toxic:
        return NOTHING
    known = sorted(bytes(r["word"]) for r in telling(sample.select("label", F.explode("words").alias("word")), n_toxic, n_clean).collect())
    if not known:
        return NOTHING
    place = {w: i for i, w in enumerate(known)}
    at = docs.sparkSession.sparkContext.broadcast(place)

    def kept(batches):
        import pandas as pd

        for pdf in batches:
            found = [sorted((at.value[bytes(w)], log1p(n)) for w, n in zip(ws, ns) if bytes(w) in at.value) for ws, ns in zip(pdf["words"], pdf["n"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "cols": [[c for c, _ in f] for f in found], "vals": [[v for _, v in f] for f in found]})

    rows = sample.mapInPandas(kept, "doc_id long, label int, cols array<int>, vals array<double>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["cols"], r["vals"]))
    x, toxic = [(r["cols"], r["vals"]) for r in rows], [r["label"] > 0 for r in rows]
    weights, thresholds = fit_rows(x, grade_of(x, toxic, len(known)), len(known))
    return Model({w: float(v) for w, v in zip(known, weights) if abs(v) > 1e-6}, thresholds)


def scores(spark: SparkSession, model: Model, text: Column) -> Column:
    """A struct of severity, p_toxic, grade and toxic for each text."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("severity double, p_toxic double, grade int, toxic boolean")
    def scored(texts):
        import pandas as pd

        m = held.value
        p = m.above([m.eta(t) for t in texts])
        grade = (p >= 0.5).sum(axis=1)
        return pd.DataFrame({"severity": p.sum(axis=1), "p_toxic": p[:, 0], "grade": grade, "toxic": grade > 0})

    return scored(text)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", scores(spark, model, F.col("text")).alias("s")).select("doc_id", "s.severity", "s.p_toxic", "s.grade", "s.toxic")


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE_SQL: dict[str, str] = {}
