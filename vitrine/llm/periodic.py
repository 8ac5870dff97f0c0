"""Periodic runs of words, found by a dictionary of basic factors.

A run is a stretch of words with least period q (words q apart are equal) that no neighbouring word extends, and which is
at least `power` periods and `least` words long. For each power of two L the dictionary names the factors of L words, so
that equal factors share a name: a name of 2L is the pair of the names of its halves. Occurrences of one factor that stand
within twice its length (whose starts are L or less apart) form arithmetic progressions, and their step is a period there:
neighbouring places whose next occurrence is q words on make one proposal. Proposals are extended word by word to both
sides, kept where they are long enough, and a run that several lengths propose is kept once.

All lengths work on many documents at once, laid end to end; factors never cross documents. A run's words recur within
a `power`-th of the document, so a place whose factor doesn't recur within that distance is given up for all greater lengths,
which leaves few places after the first ones in ordinary text.

Memory is that of a batch of documents, or of one long document. Nothing is shuffled.

Defined cases: null and empty text have no words and no runs; each row is a document of its own, also where ids repeat
or are null; runs may overlap, and a word is dropped if any run holds it after the run's first period; other columns of the
input are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import fresh, table

LEAST, POWER = 6, 4
#: Words that are worked on together; a longer document is a batch of its own.
BATCH_WORDS = 1 << 18
SPACE = r"[\x20\x09-\x0D]+"
RUN = "struct<start:long,length:long,period:long>"


def _proposals(order, gap, near, factor: int):
    """(start, end, period) for each stretch of places with one step to their next occurrence, which is near."""
    at, step = order[:-1][near], gap[near]
    by_place = np.argsort(at)
    at, step = at[by_place], step[by_place]
    first = np.ones(len(at), bool)
    first[1:] = (np.diff(at) > 1) | (np.diff(step) != 0)
    last = np.append(first[1:], True)
    return at[first], at[last] + factor + step[last], step[first]


def _extended(words, start, end, period, begins, ends):
    """The proposals with every word to the left and right that keeps the period, within their documents."""
    on = np.arange(len(start))
    while len(on):
        on = on[start[on] > begins[on]]
        on = on[words[start[on] - 1] == words[start[on] - 1 + period[on]]]
        start[on] -= 1
    on = np.arange(len(start))
    while len(on):
        on = on[end[on] < ends[on]]
        on = on[words[end[on]] == words[end[on] - period[on]]]
        end[on] += 1
    return start, end


def runs_of(words, lengths, least: int = LEAST, power: int = POWER):
    """(document, start within it, length, period) arrays of all runs of words (integers, equal for equal words) that are
    cut into documents of the given lengths; by document, start and period."""
    words, lengths = np.asarray(words, np.int64), np.asarray(lengths, np.int64)
    after = np.cumsum(lengths)
    document = np.repeat(np.arange(len(lengths)), lengths)
    end_of, longest = after[document], (lengths // power)[document]
    alive, key, factor, found = np.flatnonzero(longest > 0), words, 1, []
    key = key[alive]
    while len(alive):
        by_key = np.argsort(key, kind="stable")  # equal factors in the order of their places
        order, key = alive[by_key], key[by_key]
        gap, new = np.diff(order), key[1:] != key[:-1]
        again = ~new & (order[1:] < end_of[order[:-1]]) & (gap <= longest[order[:-1]])
        near = again & (gap <= factor)
        if near.any():
            found.append(_proposals(order, gap, near, factor))
        recurs = np.zeros(len(order), bool)
        recurs[:-1] |= again
        recurs[1:] |= again
        name = np.full(len(words) + 1, -1, np.int64)
        name[order[recurs]] = np.concatenate([[0], np.cumsum(new)])[recurs]
        alive = np.sort(order[recurs])
        # greater factors only where greater periods are possible, and where both halves recur
        alive = alive[(longest[alive] > factor) & (alive + 2 * factor <= end_of[alive])]
        alive = alive[name[alive + factor] >= 0]
        key = name[alive] * (len(words) + 1) + name[alive + factor]
        factor *= 2
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    start, end, period = (np.concatenate(x) for x in zip(*found))
    owner = document[start]
    start, end = _extended(words, start, end, period, (after - lengths)[owner], after[owner])
    enough = end - start >= np.maximum(least, power * period)
    rows = np.unique(np.stack([owner, start - (after - lengths)[owner], period, end - start], axis=1)[enough], axis=0)
    return rows[:, 0], rows[:, 1], rows[:, 3], rows[:, 2]


def _batches(texts):
    """(rows, words of all, lengths) for runs of rows with about BATCH_WORDS words."""
    words, lengths = [], []
    for t in texts:
        own = ("" if t is None else t).encode("utf-8", "replace").split()
        if lengths and len(words) + len(own) > BATCH_WORDS:
            yield words, lengths
            words, lengths = [], []
        words += own
        lengths.append(len(own))
    if lengths:
        yield words, lengths


def periodic_runs(docs: DataFrame, least: int = LEAST, power: int = POWER, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, in words, by start and period) and collapsed (binary: the words
    that stay, joined by a space) of each row."""

    def found(batches):
        import pandas as pd

        for pdf in batches:
            at = 0
            for words, lengths in _batches(pdf["t"]):
                names: dict[bytes, int] = {}
                ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
                owner, start, length, period = runs_of(ids, lengths, least, power)
                ends = np.cumsum(lengths)
                change = np.zeros(len(words) + 1, np.int64)
                begin = (ends - lengths)[owner] + start
                np.add.at(change, begin + period, 1)
                np.add.at(change, begin + length, -1)
                dropped = np.cumsum(change[:-1]) > 0
                runs: list[list] = [[] for _ in lengths]
                for d, s, n, p in zip(owner.tolist(), start.tolist(), length.tolist(), period.tolist()):
                    runs[d].append({"start": s, "length": n, "period": p})
                collapsed = []
                for s, e, r in zip((ends - lengths).tolist(), ends.tolist(), runs):
                    kept = [w for w, gone in zip(words[s:e], dropped[s:e].tolist()) if not gone] if r else words[s:e]
                    collapsed.append(b" ".join(kept))
                ids = pdf["doc_id"].iloc[at : at + len(lengths)].astype("Int64")
                at += len(lengths)
                yield pd.DataFrame({"doc_id": ids.to_numpy(object), "n_words": lengths, "runs": runs, "collapsed": collapsed}).astype({"doc_id": "Int64"})

    schema = f"doc_id long, n_words long, runs array<{RUN}>, collapsed binary"
    return fresh(docs, doc_id, text).toDF("doc_id", "t").mapInPandas(found, schema)


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; the documents whose id has a CRC-32 h divisible by 10 repeat p of their words from word a on, to their
    end: g = h div 10, a = g mod n, p = 1 + (n - a) div (3 + g mod 8). The words of such texts are joined by a space."""
    words = F.array_remove(F.split("text", SPACE), "")
    df = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    df = df.withColumn("words", F.when((F.col("h") % 10 == 0) & F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), words))
    df = df.select("doc_id", "text", "words", F.size("words").alias("n"), F.floor(F.col("h") / 10).alias("g"))
    df = df.withColumn("a", F.when(F.col("words").isNotNull(), (F.col("g") % F.col("n")).cast("int")))
    df = df.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int")))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), left)), " ")
    return df.select("doc_id", F.when(F.col("words").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_tails(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("slow"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    df = found.withColumns({"top": longest, "runs_sha256": F.sha2(F.array_join(lines, ""), 256), "collapsed_sha256": F.sha2("collapsed", 256)})
    df = df.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.back")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.slow")).alias("period"), "runs_sha256", "collapsed_sha256")
    return df.select("doc_id", "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
#: Every pair of words a period apart, for every period, is too much for SQL; tests/llm compares with brute force.
ORACLE_SQL: dict[str, str] = {}
