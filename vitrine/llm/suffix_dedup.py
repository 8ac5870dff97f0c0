"""Removal of repeated byte strings by longest-previous-factor arrays.

Texts are cut into segments (see segments.py) so that equal windows of `width` bytes meet in one block. A block's distinct
segments are laid end to end in the order of their first places, and their suffixes are sorted (see suffixes.py). The
previous and next smaller positions in suffix order give each position its longest previous factor, the longest match
that starts at an earlier position: where it has width bytes or more, a later copy starts. `keep_first` removes later
copies only; without it every copy goes, so the sources of such factors go as well: the second place of a string can only
have its first as its source, so no first copy is left out.
Only the bytes of windows that share a hash with another are sorted: matches of width bytes or more lie in them whole.

A segment that occurs more than once is a copy as a whole, so only one of its kind is sorted. Windows under a key that
is too frequent for a block meet by a 128-bit hash of the whole window (see segments.py).

Defined cases: null text is empty; matches never cross rows; texts shorter than width lose nothing; each row is a document
of its own, also where doc_ids repeat or are null, so of equal rows all go, and with keep_first one stays; rows are
earlier by doc_id, nulls last; the text form of the result leaves out bytes of characters that were cut in two; other
columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.common import table, with_rows, written
from vitrine.llm.parts import repeated
from vitrine.llm.segments import WINDOWS, Plan, blocks, byte_hashes, content_id, covered, gram_hashes, mask_runs, met_more, met_windows, piece_runs, window_hashes
from vitrine.llm.suffixes import Suffixes

WIDTH, GRAM = 200, 32
BLOCK_BYTES = 1 << 17


def longest_factors(contents: list[bytes], width: int):
    """(starts, previous, source): where each content starts among all bytes; for each byte, the longest match of what begins
    there with an earlier position, 0 where it is under width; and whether it is where such a match was found."""
    lengths = np.fromiter(map(len, contents), np.int64, len(contents))
    offsets = np.cumsum(lengths) - lengths
    n = np.maximum(lengths - width + 1, 0)
    starts = np.repeat(offsets - (np.cumsum(n) - n), n) + np.arange(n.sum())
    data = np.frombuffer(b"".join(contents), np.uint8)
    previous, source = np.zeros(len(data), np.int32), np.zeros(len(data), bool)
    hashes = gram_hashes(byte_hashes(data), width)[starts] if len(starts) else np.zeros(0, np.uint64)
    by_hash = np.argsort(hashes)
    equal = hashes[by_hash[1:]] == hashes[by_hash[:-1]]
    if equal.any():
        met = by_hash[np.concatenate([[False], equal]) | np.concatenate([equal, [False]])]
        change = np.zeros(len(data) + 1, np.int32)
        np.add.at(change, starts[met], 1)
        np.add.at(change, starts[met] + width, -1)
        at = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        cut = np.zeros(len(data), bool)  # a piece ends where a content does
        cut[offsets[lengths > 0]] = True
        first = np.ones(len(at), bool)
        first[1:] = (np.diff(at) > 1) | cut[at[1:]]
        order = Suffixes(data[at], np.diff(np.append(np.flatnonzero(first), len(at))))
        length, where = order.previous_factors(np.arange(len(at), dtype=np.int32), width)
        enough = length >= width
        previous[at[enough]] = length[enough]
        source[at[where[enough]]] = True
    return offsets, previous, source


def repeated_spans(rows: DataFrame, width: int = WIDTH, gram: int = GRAM, keep_first: bool = True) -> DataFrame:
    """row and spans (array of structs start, inner: runs of windows to remove, from start on) of the rows that lose bytes."""
    plan = Plan(rows, "bytes", width, gram, False)
    flagged = plan.flagged()

    def factors(contents, _):
        _, previous, source = longest_factors(contents, width)
        return previous > 0, source

    def compared(batches):
        import pandas as pd

        for block in blocks(batches, "deal", BLOCK_BYTES):
            block = {c: v[np.lexsort((block["start"], block["doc"]))] for c, v in block.items()}
            content, full, count = block["content"], block["full"].astype(bool), block["count"]
            met = met_more(block)
            starts, again, source = repeated(list(content[met]), np.arange(met.sum()), "bytes", width, factors, True)
            later = piece_runs(again, starts)
            every = later if keep_first else piece_runs(again | source, starts)
            number, out = np.cumsum(met) - 1, []
            for i in np.flatnonzero(full | met | (count > 1)).tolist():
                j = number[i] if met[i] else -1
                if full[i] or count[i] > 1 or j in every:
                    windows = window_hashes(content[i], "bytes", width) if full[i] else None
                    out.append((block["key"][i], content_id(content[i]), block["doc"][i], block["start"][i], count[i], later.get(j, []), every.get(j, []), windows))
            if out:
                yield pd.DataFrame(out, columns=["key", "cid", "first_doc", "first_start", "count", "later", "every", "windows"])

    schema = f"key long, cid long, first_doc long, first_start int, count long, later array<int>, every array<int>, windows {WINDOWS}"
    found = written(plan.distinct(flagged).mapInPandas(compared, schema), "found")
    full = found.where("windows is not null")
    found = found.where("windows is null").drop("windows")
    if full.take(1):
        met = met_windows(full, F.struct("first_doc", F.col("first_start") + F.col("at")))
        none = F.array().cast("array<int>")
        full = full.select("key", "cid", "first_doc", "first_start", "count").join(met, ["key", "cid"], "left").where("count > 1 or every is not null")
        found = found.unionByName(full.withColumns({c: F.coalesce(c, none) for c in ("later", "every")}))
    places = plan.places(flagged).join(found, ["key", "cid"])
    whole = F.array(F.lit(0), F.col("n"))
    if keep_first:
        first = (F.col("row") == F.col("first_doc")) & (F.col("start") == F.col("first_start"))
        inner = F.when(first, F.col("later")).otherwise(whole)
    else:
        inner = F.when(F.col("count") > 1, whole).otherwise(F.col("every"))
    spans = places.select("row", "start", inner.alias("inner")).where(F.size("inner") > 0)
    return spans.groupBy("row").agg(F.collect_list(F.struct("start", "inner")).alias("spans"))


def remove_repeats(
    docs: DataFrame, width: int = WIDTH, gram: int = GRAM, keep_first: bool = True, text: str = "text", as_text: bool = False, carry: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, kept (binary: the bytes that stay, joined; a string with as_text), removed (array of start, end, start, end,
    ... in bytes), n_bytes, and a struct `carried` of the columns in carry, for each row."""
    others = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.lit(0)
    rows, _ = with_rows(docs.select(F.col("doc_id"), F.col(f"`{text}`").alias("text"), others.alias("carried")))
    spans = repeated_spans(rows.select("row", "text"), width, gram, keep_first)

    def cut(batches):
        import pandas as pd

        for pdf in batches:
            kept, removed, sizes = [], [], []
            for t, s in zip(pdf["text"], pdf["spans"]):
                data = ("" if t is None else t).encode("utf-8", "replace")
                sizes.append(len(data))
                gone = []
                if s is not None and len(s):
                    starts = np.concatenate([x["start"] + np.asarray(x["inner"][::2], np.int64) for x in s])
                    ends = np.concatenate([x["start"] + np.asarray(x["inner"][1::2], np.int64) for x in s])
                    mask = covered(len(data), width, starts, ends)
                    gone = mask_runs(mask)
                    data = np.frombuffer(data, np.uint8)[~mask].tobytes()
                removed.append(gone)
                kept.append(data.decode("utf-8", "ignore") if as_text else data)
            out = pdf[["doc_id", "carried"]].astype({"doc_id": "Int64"})
            yield out.assign(kept=kept, removed=removed, n_bytes=sizes)

    kept = T.StringType() if as_text else T.BinaryType()
    schema = T.StructType([T.StructField("doc_id", T.LongType()), rows.schema["carried"], T.StructField("kept", kept), T.StructField("removed", T.ArrayType(T.IntegerType())), T.StructField("n_bytes", T.LongType())])
    return rows.join(spans, "row", "left").select("doc_id", "text", "carried", "spans").mapInPandas(cut, schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), keep_first=False)
    pairs = F.size("removed").cast("long")
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), (pairs / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
