"""Segments: how repeated windows of a corpus meet without a row for each window.

A text is a sequence of tokens (bytes, or words), a window is `width` consecutive tokens. A window's key is the least
hash of its runs of `gram` tokens, so it depends on the window's content alone: equal windows have equal keys, wherever
they stand. Consecutive windows with one key make a segment, and a segment's content holds all their tokens. Windows
can only be equal if their segments have equal keys, so segments are compared within a key, and a key that occurs once
needs no comparison at all.

1. keys: (row, key) for each place of a least gram; a key stays if it occurs often enough to matter.
2. flagged: the keys that stay, brought back to their rows; those that occur more than HOT times are marked. Windows under a
   hot key are keyed by the least hashes in three further orders as well, so a line or phrase that half the corpus holds
   doesn't make one group of all its contexts.
3. contents: the distinct segments of the keys, equal ones collapsed before they are shuffled.
4. A block of whole keys at a time is compared by the caller's method, and gives spans within distinct segments. How many
   contexts share all four least hashes isn't bounded by anything but the key's own count, so the segments of a key that
   occurs more than FULL times are not gathered: each distinct one gives a 128-bit hash for each of its windows, and the
   windows meet by hash.
5. The spans go back to the rows that hold those segments.

Everything is a shuffle on a key; memory in a task is a batch of texts or a block of distinct segments, of at most FULL
places for each key.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import written

#: Rows of a key above which its windows are keyed by more orders, and above which they meet by hash.
HOT, FULL = 1000, 1 << 16
ORDERS = 3
#: Windows in a segment at most; longer runs of one key are cut.
RUN = {"bytes": 512, "words": 64}
#: Bytes of text that are hashed together.
CHUNK = 1 << 20

MIX, MULTIPLY = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
_TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def byte_hashes(data):
    return _TABLE[data]


def mixed(h):
    h = h ^ (h >> np.uint64(31))
    h = h * MIX
    return h ^ (h >> np.uint64(29))


def gram_hashes(tokens, gram: int):
    """Hash of tokens[i : i + gram] for each i, by doubling; gram is any number from 1."""
    n = len(tokens) - gram + 1
    if n <= 0:
        return tokens[:0]
    out, size, power, at = None, 1, tokens, 0
    factor = MULTIPLY
    while True:
        if gram & size:
            part = power[at : at + n]
            out = part.copy() if out is None else out * factor + part
            at += size
        size <<= 1
        if size > gram:
            return mixed(out)
        half = size >> 1
        power = power[:-half] * factor + power[half:]
        factor = np.uint64((int(factor) * int(factor) + 2) & int(LAST))


def sliding_min(h, w: int, least=np.minimum):
    n = len(h) - w + 1
    if n <= 0:
        return h[:0]
    size = 1
    while size * 2 <= w:
        h = least(h[:-size], h[size:])
        size *= 2
    if size < w:
        h = least(h[: -(w - size)], h[w - size :])
    return h[:n]


class Tokens:
    """The tokens of one text: their hashes, and the content of any run of them."""

    def __init__(self, text: str | None, kind: str):
        data = (text or "").encode("utf-8", "replace")
        self.kind = kind
        if kind == "bytes":
            self.data = data
            self.hashes = byte_hashes(np.frombuffer(data, np.uint8))
            return
        b = np.frombuffer(data, np.uint8)
        word = np.ones(len(b) + 2, bool)
        word[0] = word[-1] = False
        word[1:-1] = ~((b == 32) | ((b >= 9) & (b <= 13)))
        edges = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edges[::2], edges[1::2]
        self.data, self.at, self.lengths = data, None, ends - starts
        self.hashes = _word_hashes(b, starts, ends)

    def __len__(self):
        return len(self.hashes)

    def content(self, start: int, end: int) -> bytes:
        if self.kind == "bytes":
            return self.data[start:end]
        if self.at is None:  # a single space between words, so that content is the words joined by one space
            self.data = b" ".join(self.data.split())
            self.at = [0, *np.cumsum(self.lengths + 1).tolist()]
        return self.data[self.at[start] : self.at[end] - 1]


def _word_hashes(b, starts, ends):
    """Sum over a word's bytes of table[byte] * odd power of its place, taken from prefix sums."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    within = np.arange(len(b), dtype=np.int64)
    owner = np.repeat(np.arange(len(starts)), length)
    flat = _spans(starts, length)
    place = within[flat] - starts[owner]
    values = mixed(_TABLE[b[flat]] + place.astype(np.uint64) * MULTIPLY)
    total = np.add.reduceat(values, np.concatenate([[0], np.cumsum(length)[:-1]]))
    return mixed(total + length.astype(np.uint64) * MIX)


def _spans(starts, lengths):
    """Indices of all runs, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - np.concatenate([[0], ends[:-1]]), lengths) + np.arange(ends[-1] if len(ends) else 0)


def window_keys(hashes, width: int, gram: int):
    """(keys of windows, gram hashes) of one token sequence."""
    grams = gram_hashes(hashes, gram)
    return sliding_min(grams, width - gram + 1), grams


def key_places(keys, grams, width: int, gram: int):
    """Hash at each place whose gram is the least of a window."""
    if not len(keys):
        return keys
    w = width - gram + 1
    pad = np.zeros(w - 1, np.uint64)
    most = sliding_min(np.concatenate([pad, keys, pad]), w, np.maximum)
    return grams[most == grams]


def with_orders(keys, hot, grams, width: int, gram: int):
    """keys, those of windows under a hot key mixed with the least hashes in more orders."""
    if not len(hot) or not (is_hot := np.isin(keys, hot)).any():
        return keys
    more = keys
    for i in range(ORDERS):
        shift = np.uint64(2 * i + 1) * np.array([MULTIPLY])
        more = mixed(more * MULTIPLY + sliding_min(mixed(grams + shift), width - gram + 1))
    return np.where(is_hot, more, keys)


def runs(keys, longest: int):
    """(start, end) arrays of the segments' windows."""
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    starts = np.concatenate([[0], cut])
    ends = np.concatenate([cut, [len(keys)]])
    pieces = -(-(ends - starts) // longest)
    if (pieces > 1).any():
        step = np.concatenate([np.arange(p) for p in pieces]) * longest
        starts = np.repeat(starts, pieces) + step
        ends = np.minimum(np.repeat(ends, pieces), starts + longest)
    return starts, ends


def content_id(content: bytes) -> int:
    """Signed 64-bit id of a segment's content; with the key it names the segment."""
    h = xxhash.xxh3_64_intdigest(content)
    return h - (1 << 64) if h >> 63 else h


def window_hashes(content: bytes, kind: str, width: int) -> list[dict]:
    """A 128-bit hash, as two longs, of each window of a segment's content."""
    tokens = content if kind == "bytes" else content.split(b" ")
    n = len(tokens) - width + 1
    h = xxhash.xxh3_128_digest
    found = [h(tokens[i : i + width]) for i in range(n)] if kind == "bytes" else [h(b" ".join(tokens[i : i + width])) for i in range(n)]
    return [{"h1": a, "h2": b} for a, b in np.frombuffer(b"".join(found), np.int64).reshape(-1, 2).tolist()]


WINDOWS = "array<struct<h1:long,h2:long>>"


class Plan:
    """The steps above for one kind of token and window.

    docs has a column row, a long of its own for each row, and text. Between documents, it has a column doc as well: the
    document that a row belongs to, by whose order copies are earlier or later; row itself where that is the same."""

    def __init__(self, docs: DataFrame, kind: str, width: int, gram: int, between_documents: bool):
        self.docs, self.kind, self.width, self.gram, self.between = docs, kind, width, gram, between_documents
        self.doc = "doc" if "doc" in docs.columns else "row"

    def keys(self) -> DataFrame:
        """row and key for each key of a row; within documents, twice for a key that a row has more than once."""
        kind, width, gram, between = self.kind, self.width, self.gram, self.between

        def found(batches):
            import pandas as pd

            for pdf in batches:
                ids, keys, size = [], [], 0
                for d, t in zip(pdf["row"].to_numpy(), pdf["text"]):
                    places = key_places(*window_keys(Tokens(t, kind).hashes, width, gram), width, gram)
                    k, n = np.unique(places, return_counts=True)
                    if not between:
                        k = np.concatenate([k, k[n > 1]])
                    ids.append(np.full(len(k), d))
                    keys.append(k.view(np.int64))
                    size += len(k)
                    if size > CHUNK // 4:
                        yield pd.DataFrame({"row": np.concatenate(ids), "key": np.concatenate(keys)})
                        ids, keys, size = [], [], 0
                if size:
                    yield pd.DataFrame({"row": np.concatenate(ids), "key": np.concatenate(keys)})

        return self.docs.select("row", "text").mapInPandas(found, "row long, key long")

    def flagged(self) -> DataFrame:
        """row, keys, and those of the keys that are hot and full, of the rows with a key that matters."""
        rows = self.keys().repartition("key")  # one exchange for both uses
        shared = rows.groupBy("key").agg(F.count("row").alias("c")).where("c > 1")  # of row, or the exchange would hold other columns
        kept = rows.join(shared, "key").groupBy("row")
        over = lambda n: F.collect_list(F.when(F.col("c") > n, F.col("key")))
        return written(kept.agg(F.collect_list("key").alias("keys"), over(HOT).alias("hot"), over(FULL).alias("full")), "flagged")

    def _cut(self, flagged: DataFrame, collected, schema: str) -> DataFrame:
        """collected's rows of the segments under flagged keys: it takes row, doc, arrays of keys, starts and lengths in
        windows, of whether the key is full, the contents, and a function that tells of a segment by its number whether it
        may hold a window twice; and it gives frames."""
        kind, width, gram, doc, between = self.kind, self.width, self.gram, self.doc, self.between
        reach = width - gram

        def pieces(batches):
            for pdf in batches:
                for r, d, t, keys, hot, full in zip(pdf["row"].tolist(), pdf[doc].tolist(), pdf["text"], pdf["keys"], pdf["hot"], pdf["full"]):
                    tokens = Tokens(t, kind)
                    of_windows, grams = window_keys(tokens.hashes, width, gram)
                    if not len(of_windows):
                        continue
                    keys, hot, full = (np.asarray(k, np.int64).view(np.uint64) for k in (keys, hot, full))
                    named = with_orders(of_windows, hot, grams, width, gram)
                    starts, ends = runs(named, RUN[kind])
                    on = np.isin(of_windows[starts], keys)
                    starts, ends = starts[on], ends[on]
                    is_full = np.isin(of_windows[starts], full) if len(full) else np.zeros(len(starts), bool)
                    contents = [tokens.content(s, e) for s, e in zip(starts.tolist(), (ends + width - 1).tolist())]

                    def twice(i, starts=starts, ends=ends, grams=grams, of_windows=of_windows):  # its least gram is there twice
                        return not between and bool(np.count_nonzero(grams[starts[i] : ends[i] + reach] == of_windows[starts[i]]) > 1)

                    yield r, d, named[starts].view(np.int64), starts, ends - starts, is_full, contents, twice

        names = ["row", *(["doc"] if doc == "doc" else []), "text", "keys", "hot", "full"]
        return self.docs.join(flagged, "row").select(*names).mapInPandas(lambda batches: collected(pieces(batches)), schema)

    def places(self, flagged: DataFrame) -> DataFrame:
        """key, row (and doc), start, n (windows) and the content's id of each segment."""
        own = self.doc == "doc"
        types = {"key": "long", "row": "long", **({"doc": "long"} if own else {}), "start": "int", "n": "int", "cid": "long"}

        def collected(pieces):
            import pandas as pd

            held, size = {c: [] for c in types}, 0
            for r, d, keys, starts, n, _, contents, _ in pieces:
                ids = np.fromiter(map(content_id, contents), np.int64, len(contents))
                row = {"key": keys, "row": np.full(len(keys), r), "doc": np.full(len(keys), d), "start": starts, "n": n, "cid": ids}
                for c in held:
                    held[c].append(row[c])
                size += len(keys)
                if size > CHUNK // 16:
                    yield pd.DataFrame({c: np.concatenate(v) for c, v in held.items()})
                    held, size = {c: [] for c in types}, 0
            if size:
                yield pd.DataFrame({c: np.concatenate(v) for c, v in held.items()})

        return self._cut(flagged, collected, ", ".join(f"{c} {t}" for c, t in types.items()))

    def distinct(self, flagged: DataFrame) -> DataFrame:
        """deal, key, full, twice, content, the first place (doc, start) and count of each distinct segment, whole keys together
        and in order; segments of full keys are dealt one by one. Equal segments are combined before they are shuffled, once."""
        between = self.between

        def collected(pieces):
            import pandas as pd

            held, size = {}, 0

            def frame():
                (keys, contents), (full, twice, docs, starts, counts) = zip(*held), zip(*held.values())
                full = np.array(full, bool)
                deal = np.array(keys, np.int64)
                for i in np.flatnonzero(full).tolist():
                    deal[i] = content_id(contents[i])
                return pd.DataFrame({"deal": deal, "key": np.array(keys, np.int64), "full": full, "twice": np.array(twice, bool), "content": contents, "doc": np.array(docs, np.int64), "start": np.array(starts, np.int32), "count": np.array(counts, np.int64)})

            for _, d, keys, starts, _, full, contents, twice in pieces:
                for i, place in enumerate(zip(keys.tolist(), contents)):
                    known = held.get(place)
                    if known is None:
                        held[place] = [full[i], twice(i), d, 0 if between else int(starts[i]), 1]
                        size += len(contents[i])
                    else:
                        known[4] += 1
                        if between:
                            known[2] = min(known[2], d)
                        elif (d, starts[i]) < (known[2], known[3]):
                            known[2], known[3] = d, int(starts[i])
                if size > CHUNK * 8:
                    yield frame()
                    held, size = {}, 0
            if held:
                yield frame()

        schema = "deal long, key long, full boolean, twice boolean, content binary, doc long, start int, count long"
        dealt = self._cut(flagged, collected, schema).repartition("deal").groupBy("deal", "key", "full", "twice", "content")
        if between:
            found = dealt.agg(F.min("doc").alias("doc"), F.lit(0).alias("start"), F.sum("count").alias("count"))
        else:
            found = dealt.agg(F.min(F.struct("doc", "start")).alias("first"), F.sum("count").alias("count")).select("deal", "key", "full", "twice", "content", "first.doc", "first.start", "count")
        return found.sortWithinPartitions("deal")


def met_windows(pieces: DataFrame, place: Column) -> DataFrame:
    """key, cid, later (the windows that occur at an earlier place) and every (those that occur twice or more) of the
    pieces of full keys (key, cid, first_doc, first_start, windows) with such windows; place is made of these and at, the window's number."""
    rows = pieces.select("key", "cid", "first_doc", "first_start", F.posexplode("windows").alias("at", "w"))
    rows = rows.select("key", "cid", "at", place.alias("place"), "w.h1", "w.h2")
    least = rows.groupBy("h1", "h2").agg(F.min("place").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = rows.join(least, ["h1", "h2"]).select("key", "cid", "at", F.when(F.col("place") > F.col("least"), F.col("at")).alias("later"))
    runs_of = lambda c: F.flatten(F.transform(F.collect_list(c), lambda x: F.array(x, x + 1)))
    return met.groupBy("key", "cid").agg(runs_of("later").alias("later"), runs_of("at").alias("every"))


def blocks(batches, key: str, size: int):
    """Arrays by column of about size bytes of content together, from batches sorted by key; a key is never split."""
    held: dict = {}
    for pdf in batches:
        cols = {c: pdf[c].to_numpy() for c in pdf.columns}
        held = {c: np.concatenate([held[c], v]) for c, v in cols.items()} if held else cols
        keys = held[key]
        total = np.cumsum(np.fromiter(map(len, held["content"]), np.int64, len(keys)))
        cuts, done = np.flatnonzero(keys[1:] != keys[:-1]) + 1, 0
        while len(cuts):
            at = np.searchsorted(total[cuts - 1], (total[done - 1] if done else 0) + size)
            if at == len(cuts):
                break
            yield {c: v[done : cuts[at]] for c, v in held.items()}
            done, cuts = cuts[at], cuts[at + 1 :]
        held = {c: v[done:] for c, v in held.items()}
    if held and len(held[key]):
        yield held


def met_more(block) -> np.ndarray:
    """Which segments of a block have to be compared: those that share a key that isn't full, or may hold a window twice."""
    _, inverse, n = np.unique(block["key"], return_inverse=True, return_counts=True)
    return ~block["full"].astype(bool) & ((n[inverse] > 1) | block["twice"].astype(bool))


def piece_runs(mask, starts) -> dict[int, list[int]]:
    """[start, end, ...] within its piece of the true runs of mask, by the number of the piece; runs don't cross pieces."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    begins, ends = edges[::2], edges[1::2]
    piece = np.searchsorted(starts, begins, "right") - 1
    found: dict[int, list[int]] = {}
    for p, s, e in zip(piece.tolist(), (begins - starts[piece]).tolist(), (ends - starts[piece]).tolist()):
        found.setdefault(p, []).extend((s, e))
    return found


def mask_runs(mask) -> list[int]:
    """[start, end, start, end, ...] of the true runs."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edges.tolist()


def covered(n_tokens: int, width: int, starts, ends):
    """Which tokens are in a window that starts in one of the [start, end) runs."""
    change = np.zeros(n_tokens + 1, np.int32)
    np.add.at(change, np.asarray(starts, np.int64), 1)
    np.add.at(change, np.minimum(np.asarray(ends, np.int64) + width - 1, n_tokens), -1)
    return np.cumsum(change[:-1]) > 0
