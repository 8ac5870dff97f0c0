"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts become bytes of lower-case words with a space before, between and after them. A benchmark window is such a string of
its own, so that it only occurs at whole words. Windows of one number of words are searched together: m is the length of the
shortest, and only the first m bytes of each matter for skipping. A table holds, for the hash of every block of eight bytes, by
how much a search may move on when it stands on that block: the distance of the block's last place among the first m bytes of
any window to their end, and past the whole block where no window has it. Where the table says 0, the block ends the first
m bytes of some window: the block's bucket holds those windows, and the text's own words from there on are compared with
them directly. A batch of documents is searched by thousands of cursors at once, each over a stretch of its own, in numpy.

The windows reach the tasks as a broadcast variable of a bounded size: they are dealt by hash into as few shards of about
SHARD_BYTES as they need, and every shard is one more pass over the documents, whose hits are then brought together by row.
The usual benchmark is a single shard, and then nothing of the documents is shuffled.

Defined cases: null and empty texts have no words; an item of fewer words than a window is one window, an item without words
none; items that share an id are one item, whose windows don't cross rows; an item without an id marks words, but is neither
counted nor listed; documents that repeat an id or have none are searched each on their own; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import fresh, table, with_rows, written

WIDTH = 10
#: Bytes of a block; a block is one unsigned integer.
BLOCK = 8
#: Bytes of windows and item ids in one broadcast, about.
SHARD_BYTES = 1 << 24
#: Bytes of text that are searched together (or one longer text), and places for one cursor.
BATCH_BYTES, STRETCH = 1 << 22, 2048

MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _mapping():
    to = np.full(256, 32, np.uint8)
    for first, last, shift in ((0x30, 0x39, 0), (0x41, 0x5A, 32), (0x61, 0x7A, 0), (0x80, 0xFF, 0)):
        to[first : last + 1] = np.arange(first, last + 1) + shift
    return to


#: A-Z in lower case; all that is no part of a word is a space.
_TO = _mapping()


def normalised(texts: list[bytes]):
    """The texts end to end, each as a space, its words with a space after each, and a zero byte."""
    raw = np.frombuffer(b" " + b" \0 ".join(texts) + b" \0", np.uint8)
    data = _TO[raw]
    data[np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 3) - 1] = 0
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    return data[keep]


def windows_of(text: bytes, width: int = WIDTH) -> set[bytes]:
    """The distinct windows of one item."""
    words = normalised([text]).tobytes()[:-1].split()
    return {b" " + b" ".join(words[i : i + width]) + b" " for i in range(max(1, len(words) - width + 1))} if words else set()


class WuManber:
    """Search for patterns that all have the same number of words."""

    def __init__(self, patterns: list[bytes], words: int):
        self.words, self.shortest = words, min(map(len, patterns))
        self.block = min(BLOCK, self.shortest)
        self.mask = np.uint64((1 << (8 * self.block)) - 1)
        m = self.shortest
        heads = np.zeros((len(patterns), m + BLOCK), np.uint8)
        heads[:, :m] = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(-1, m)
        places = m - self.block
        bits = min(22, max(12, int(np.log2(8 * len(patterns) * min(places + 1, 8))) + 1))
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, places + 1, np.uint16 if places < 1 << 16 else np.int64)
        for at in range(places + 1):  # later places overwrite with the smaller shift
            blocks = np.ascontiguousarray(heads[:, at : at + BLOCK]).view("<u8").ravel() & self.mask
            self.shift[self.slots(blocks)] = places - at
        self.buckets: dict[int, set[bytes]] = {}
        for block, p in zip(blocks.tolist(), patterns):
            self.buckets.setdefault(block, set()).add(p)
        self.ends = np.array(sorted(self.buckets), np.uint64)

    def slots(self, blocks):
        return ((blocks * MULTIPLY) >> self.down).astype(np.int64)

    def candidates(self, data):
        """(place, block) of each place where a pattern may start."""
        n = len(data) - self.shortest + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        padded = np.concatenate([data, np.zeros(BLOCK, np.uint8)])
        blocks = np.ndarray((len(data),), "<u8", padded, strides=(1,))
        ahead, found = self.shortest - self.block, []
        at = np.arange(0, n, STRETCH)
        stop = np.minimum(at + STRETCH, n)
        while len(at):
            shift = self.shift[self.slots(blocks[at + ahead] & self.mask)]
            found.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            on = at < stop
            if not on.all():
                at, stop = at[on], stop[on]
        at = np.sort(np.concatenate(found))
        at = at[data[at] == 32]
        ends = blocks[at + ahead] & self.mask
        place = np.minimum(np.searchsorted(self.ends, ends), len(self.ends) - 1)
        real = self.ends[place] == ends
        return at[real], ends[real]

    def occurrences(self, data, spaces):
        """(number of the space before it, pattern) of each occurrence."""
        at, ends = self.candidates(data)
        number = np.searchsorted(spaces, at)
        inside = number + self.words < len(spaces)
        at, ends, number = at[inside], ends[inside], number[inside]
        after = spaces[number + self.words] + 1
        for i, s, e, block in zip(number.tolist(), at.tolist(), after.tolist(), ends.tolist()):
            text = data[s:e].tobytes()
            if text in self.buckets[block]:  # direct comparison; a text across documents holds a zero byte
                yield i, text


class Patterns:
    """The windows of one shard, each with the ids of its items."""

    def __init__(self, items: dict[bytes, list[str]]):
        self.items = items
        by_words: dict[int, list[bytes]] = {}
        for p in items:
            by_words.setdefault(p.count(b" ") - 1, []).append(p)
        self.searches = [WuManber(p, n) for n, p in sorted(by_words.items())]

    def search(self, texts: list[bytes]):
        """(n_words, runs [start, end, ...] of words, item ids) of each text."""
        data = normalised(texts)
        spaces, marks = np.flatnonzero(data == 32), np.flatnonzero(data == 0)
        first = np.concatenate([[0], np.searchsorted(spaces, marks)])  # each text has a space before and after its words
        change, met = np.zeros(len(spaces) + 1, np.int64), [set() for _ in texts]
        for s in self.searches:
            found = list(s.occurrences(data, spaces))
            if found:
                number = np.array([i for i, _ in found])
                np.add.at(change, number, 1)
                np.add.at(change, number + s.words, -1)
                for t, (_, p) in zip((np.searchsorted(first, number, "right") - 1).tolist(), found):
                    met[t].add(p)
        hit = np.cumsum(change[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
        runs: list[list[int]] = [[] for _ in texts]
        owner = np.searchsorted(first, edges[::2], "right") - 1
        for t, s, e in zip(owner.tolist(), (edges[::2] - first[owner]).tolist(), (edges[1::2] - first[owner]).tolist()):
            runs[t] += (s, e)
        items = [sorted(set().union(*(self.items[p] for p in ps))) if ps else [] for ps in met]
        return (np.diff(first) - 1).tolist(), runs, items


def _batches(texts):
    held, size = [], 0
    for t in texts:
        t = ("" if t is None else t).encode("utf-8", "replace")
        if held and size + len(t) > BATCH_BYTES:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def window_table(items: DataFrame, width: int = WIDTH, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The distinct (window, item_id as a string) of all items."""

    def found(batches):
        import pandas as pd

        for pdf in batches:
            for i, t in zip(pdf["i"], pdf["t"]):
                own = sorted(windows_of(("" if t is None else t).encode("utf-8", "replace"), width))
                if own:
                    yield pd.DataFrame({"window": own, "item_id": [i] * len(own)}, dtype=object)

    rows = items.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{text}`").alias("t"))
    return rows.mapInPandas(found, "window binary, item_id string").distinct()


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, hits (array of start, end, in words: the runs that windows of items cover) and items (the sorted ids,
    as strings, of items with a window in the text) of each row of docs."""
    spark = docs.sparkSession
    windows = written(window_table(items, width), "windows")
    total = windows.agg(F.sum(F.length("window") + F.coalesce(F.length("item_id"), F.lit(0)) + 16)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    rows = fresh(docs, "doc_id", "text")
    rows = rows.withColumn("row", F.lit(None).cast("long")) if shards == 1 else with_rows(rows)[0]
    shard = F.pmod(F.xxhash64("window", "item_id"), F.lit(shards))

    def searched(number: int) -> DataFrame:
        known: dict[bytes, list[str]] = {}
        for w, i in windows.where(shard == number).collect():  # about shard_bytes
            ids = known.setdefault(bytes(w), [])
            if i is not None:
                ids.append(i)
        sent = spark.sparkContext.broadcast(Patterns(known))

        def found(batches):
            import pandas as pd

            for pdf in batches:
                at = 0
                for texts in _batches(pdf["text"]):
                    n, runs, ids = sent.value.search(texts)
                    part = pdf[["doc_id", "row"]].iloc[at : at + len(texts)].astype({"doc_id": "Int64", "row": "Int64"})
                    at += len(texts)
                    yield part.assign(n_words=n, hits=[[{"start": s, "end": e} for s, e in zip(r[::2], r[1::2])] for r in runs], items=ids)

        return rows.select("doc_id", "row", "text").mapInPandas(found, "doc_id long, row long, n_words long, hits array<struct<start:long,end:long>>, items array<string>")

    if shards == 1:
        return searched(0).drop("row")
    every = reduce(DataFrame.unionAll, (searched(i) for i in range(shards)))
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    met = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), flat("hits").alias("hits"), flat("items").alias("items"))
    last = lambda a: F.element_at(a, -1)
    joined = F.aggregate(
        "hits",
        F.array().cast("array<struct<start:long,end:long>>"),
        lambda a, x: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] >= x["start"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], x["end"]).alias("end"))))).otherwise(F.concat(a, F.array(x))),
    )
    return met.select("doc_id", "n_words", joined.alias("hits"), "items")


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    df = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return df.withColumn("contaminated", F.col("n_hit") > 0)


QUERIES = {"op12_decontaminate": op12_decontaminate}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[0-9a-z\x{80}-\x{10FFFF}]+'"
ORACLE_SQL = {
    "op12_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, n, array_to_string(w[j:j + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least({WIDTH}, len(w)) AS n, unnest(range(1, len(w) - least({WIDTH}, len(w)) + 2)) AS j FROM i WHERE len(w) > 0)),
g AS (
  SELECT r, n, j, array_to_string(w[j:j + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS j FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
o AS MATERIALIZED (SELECT r, n, j, item_id FROM g JOIN p USING (n, g)),
h AS (SELECT r, count(DISTINCT j + k) AS n_hit FROM o, range(0, {WIDTH}) AS x(k) WHERE k < n GROUP BY r),
t AS (SELECT r, count(item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM o) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""
}
