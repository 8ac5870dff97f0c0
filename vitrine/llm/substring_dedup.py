"""Removal of word windows that a document with a smaller id holds, by Relative Lempel-Ziv parsing.

Segments (see segments.py) route every document to all reference blocks that can hold a window of it: a block is the
distinct segments of many whole keys, indexed by the suffix order of their words (see suffixes.py). Each segment is parsed
greedily against its block's index, restricted to the segments of documents before it: a factor is the longest match there,
and a factor of `width` words or more is a duplicate span. The next factor starts at the first window that reaches over
the boundary of the last, so windows over boundaries are checked as well and none is missed; where no match is long
enough, parsing goes on by a word. A segment is shuffled once however many documents hold it; for those after the first,
the block holds the segment itself, so their parse is one factor, the whole of it. Windows under a key that is too
frequent for a block meet by a 128-bit hash of the whole window.

Defined cases: null text has no words; texts shorter than width lose nothing; windows repeated within one document stay;
rows that repeat a doc_id are parts of one document, which no window crosses; rows without a doc_id take no part and are
kept whole; windows are judged on the input, not on what is left; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import table, with_rows, written
from vitrine.llm.parts import repeated
from vitrine.llm.segments import WINDOWS, Plan, blocks, content_id, covered, met_more, met_windows, piece_runs, window_hashes
from vitrine.llm.suffixes import Suffixes

WIDTH, GRAM = 13, 4
BLOCK_BYTES = 1 << 17


class Reference:
    """An indexed block: segments (words joined by spaces), each with the id of its first document.

    longest[i] is the longest match of the words from i on with a segment of a smaller id."""

    def __init__(self, segments: list[bytes], docs, width: int):
        self.width = width
        lengths = np.fromiter((s.count(b" ") + 1 for s in segments), np.int64, len(segments))
        self.starts = np.cumsum(lengths) - lengths
        words = b" ".join(segments).split(b" ")
        names = {w: i for i, w in enumerate(dict.fromkeys(words))}
        tokens = np.fromiter(map(names.__getitem__, words), np.int64, len(words))
        value = np.repeat(np.unique(docs, return_inverse=True)[1], lengths)
        self.longest, _ = Suffixes(tokens, lengths).previous_factors(value, width)

    def factors(self) -> list[tuple[int, int]]:
        """(start, length), counted over all segments, of the factors that are long enough, by greedy parsing."""
        at = np.flatnonzero(self.longest >= self.width)
        starts, lengths, i, out = at.tolist(), self.longest[at].tolist(), 0, []
        while i < len(starts):
            out.append((starts[i], lengths[i]))
            # a window within a factor matches as well, so this is the first that reaches over the factor's boundary
            i += lengths[i] - self.width + 1
        return out

    def seen(self):
        """Whether a window that the reference holds starts at a word."""
        seen = np.zeros(len(self.longest), bool)
        for start, n in self.factors():
            seen[start : start + n - self.width + 1] = True
        return seen

    def parse(self) -> dict[int, list[int]]:
        """[start, end, ...] by segment: runs of windows (their first words) that the reference holds."""
        return piece_runs(self.seen(), self.starts)


def duplicate_spans(rows: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """row and spans (start, inner: runs of windows from start on) of rows with windows of smaller documents."""
    plan = Plan(rows, "words", width, gram, True)
    flagged = plan.flagged()

    def parsed(batches):
        import pandas as pd

        for block in blocks(batches, "deal", BLOCK_BYTES):
            block = {c: v[np.argsort(block["doc"], kind="stable")] for c, v in block.items()}
            content, full, count = block["content"], block["full"].astype(bool), block["count"]
            met = met_more(block)
            starts, seen, _ = repeated(list(content[met]), block["doc"][met], "words", width, lambda c, d: (Reference(c, d, width).seen(), None), False)
            spans = piece_runs(seen, starts)
            number, out = np.cumsum(met) - 1, []
            for i in np.flatnonzero(full | met | (count > 1)).tolist():
                j = number[i] if met[i] else -1
                if full[i] or count[i] > 1 or j in spans:
                    windows = window_hashes(content[i], "words", width) if full[i] else None
                    out.append((block["key"][i], content_id(content[i]), block["doc"][i], 0, spans.get(j, []), windows))
            if out:
                yield pd.DataFrame(out, columns=["key", "cid", "first_doc", "first_start", "inner", "windows"])

    schema = f"key long, cid long, first_doc long, first_start int, inner array<int>, windows {WINDOWS}"
    found = written(plan.distinct(flagged).mapInPandas(parsed, schema), "found")
    full = found.where("windows is not null")
    found = found.where("windows is null").select("key", "cid", "first_doc", "inner")
    if full.take(1):
        met = met_windows(full, F.col("first_doc")).select("key", "cid", "later")
        none = F.array().cast("array<int>")
        full = full.select("key", "cid", "first_doc").join(met, ["key", "cid"], "left")
        found = found.unionByName(full.select("key", "cid", "first_doc", F.coalesce("later", none).alias("inner")))
    places = plan.places(flagged).join(found, ["key", "cid"])
    inner = F.when(F.col(plan.doc) == F.col("first_doc"), F.col("inner")).otherwise(F.array(F.lit(0), F.col("n")))
    spans = places.select("row", "start", inner.alias("inner")).where(F.size("inner") > 0)
    return spans.groupBy("row").agg(F.collect_list(F.struct("start", "inner")).alias("spans"))


def remove_duplicates(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (binary: the words that stay, joined by a space) of each row."""
    rows, is_key = with_rows(docs.select(F.col("doc_id"), F.col(f"`{text}`").alias("text")))
    taking = rows if is_key else rows.where("doc_id is not null").withColumnRenamed("doc_id", "doc")
    spans = duplicate_spans(taking.select("row", *([] if is_key else ["doc"]), "text"), width, gram)

    def cut(batches):
        import pandas as pd

        for pdf in batches:
            kept, removed, sizes = [], [], []
            for t, s in zip(pdf["text"], pdf["spans"]):
                words = ("" if t is None else t).encode("utf-8", "replace").split()
                sizes.append(len(words))
                gone = 0
                if s is not None and len(s):
                    starts = np.concatenate([x["start"] + np.asarray(x["inner"][::2], np.int64) for x in s])
                    ends = np.concatenate([x["start"] + np.asarray(x["inner"][1::2], np.int64) for x in s])
                    mask = covered(len(words), width, starts, ends)
                    gone = int(mask.sum())
                    words = [w for w, m in zip(words, mask.tolist()) if not m]
                removed.append(gone)
                kept.append(b" ".join(words))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_words": sizes, "n_removed": removed, "kept": kept})

    schema = "doc_id long, n_words long, n_removed long, kept binary"
    return rows.join(spans, "row", "left").select("doc_id", "text", "spans").mapInPandas(cut, schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLE_SQL = {
    "op2_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM g) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM dup, range(0, 13) AS r(j)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
marked AS (SELECT words.*, gone.i IS NOT NULL AS removed FROM words LEFT JOIN gone USING (doc_id, i)),
summed AS (SELECT doc_id, count(*) FILTER (removed) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT removed) AS kept FROM marked GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN summed USING (doc_id)"""
}
