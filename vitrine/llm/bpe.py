"""Byte-level BPE encoding and decoding in length-bucketed padded numpy matrices.

The distinct pieces of a batch of texts go, by length, into matrices with a row for each piece. Each round every row
merges its leftmost pair of least rank: pair ranks come from an open-addressing hash table over (left id, right id),
the merged row closes up, and rows without a pair leave the matrix. Pieces over LONG bytes would take a round a byte;
they merge by the same rule with a heap instead. Encoded pieces are kept in a bounded cache of each Python worker.

Defined cases: null or empty text has no ids; special tokens' strings are ordinary text; texts of any length are encoded
whole; repeated rows are encoded alike; no column but the named two is looked at.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from vitrine.llm.common import fresh, table

LONG = 128
CACHE_PIECES = 300_000
BATCH_PIECES = 1 << 15
NONE = np.int64(1 << 40)

#: The usual byte-level pattern, and the same for `re`, which is faster. The two agree on texts of the characters that
#: SIMPLE leaves out of its class (checked in the tests, character by character); other texts take `regex`.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FAST = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""").findall
SIMPLE = re.compile("[^\t-\r -~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]").search


class ByteBpe:
    """The tokenizer of one ranks file (a line for each token: base64, space, rank)."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex

        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {b: a for a, b in self.ranks.items()}
        split = regex.compile(pattern).findall
        self.split = (lambda t: split(t) if SIMPLE(t) else FAST(t)) if pattern == USUAL else split
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.cache: dict[str, bytes] = {}
        keys, values = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    values.append(rank)
        self._build(np.array(keys, np.int64), np.array(values, np.int64))

    def _build(self, keys, values) -> None:
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        slots, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slots[left]] < 0
            at, first = np.unique(slots[left[free]], return_index=True)
            won = left[free][first]
            self.keys[at], self.values[at] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slots[left] = np.where(self.keys[slots[left]] >= 0, (slots[left] + 1) & ((1 << self.bits) - 1), slots[left])

    def _slots(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left, right):
        """Rank of the token that each pair merges to; NONE where there is none or an id is negative."""
        keys = left.astype(np.int64) << 20 | right
        out = np.full(keys.shape, NONE, np.int64)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        slots, wanted = self._slots(keys[todo]), keys[todo]
        while len(todo):
            seen = self.keys[slots]
            hit = seen == wanted
            out[todo[hit]] = self.values[slots[hit]]
            on = ~hit & (seen >= 0)
            todo, wanted, slots = todo[on], wanted[on], (slots[on] + 1) & ((1 << self.bits) - 1)
        return out

    def encode_bucket(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of two bytes or more, in one padded matrix, as little-endian unsigned 32-bit integers."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(lengths.max())
        cells = np.full((len(pieces), width), -1, np.int32)
        cells[np.arange(width) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.pair_ranks(cells[:, :-1].ravel(), cells[:, 1:].ravel()).reshape(len(pieces), width - 1)
        names, done, sizes, flat = np.arange(len(pieces)), [], [], []
        while len(names):
            rows = np.arange(len(names))
            at = ranks.argmin(axis=1)
            best = ranks[rows, at]
            over = best == NONE
            if over.any():
                done.append(names[over])
                sizes.append(lengths[over])
                ended = cells[over]
                flat.append(ended[np.arange(ended.shape[1]) < lengths[over][:, None]])
                keep = ~over
                names, at, best, lengths = names[keep], at[keep], best[keep], lengths[keep]
                if not len(names):
                    break
                width = int(lengths.max())
                cells, ranks, rows = cells[keep, :width], ranks[keep, : width - 1], rows[: len(names)]
            # the merged cell takes the place of the pair and the row closes up behind it
            width = cells.shape[1]
            cells[rows, at] = best
            behind = np.arange(width - 1) > at[:, None]
            cells[:, :-1] = np.where(behind, cells[:, 1:], cells[:, :-1])
            if width > 2:
                ranks[:, :-1] = np.where(behind[:, :-1], ranks[:, 1:], ranks[:, :-1])
            lengths = lengths - 1
            cells[rows, lengths] = -1
            ranks[rows, lengths - 1] = NONE
            here = np.flatnonzero(at + 1 < lengths)
            ranks[here, at[here]] = self.pair_ranks(cells[here, at[here]], cells[here, at[here] + 1])
            here = np.flatnonzero(at > 0)
            ranks[here, at[here] - 1] = self.pair_ranks(cells[here, at[here] - 1], cells[here, at[here]])
        whole = memoryview(np.concatenate(flat).astype("<u4").tobytes())
        ends = np.cumsum(np.concatenate(sizes)) * 4
        out: list = [None] * len(pieces)
        for i, s, e in zip(np.concatenate(done).tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
            out[i] = bytes(whole[s:e])
        return out

    def encode_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece: a heap of (rank, place) over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        known: dict[tuple[int, int], int] = {}

        def rank(i):
            j = after[i]
            if j < 0:
                return None
            k = (ids[i], ids[j])
            if k not in known:
                known[k] = self.ranks.get(self.tokens[k[0]] + self.tokens[k[1]], -1)
            return known[k]

        first = self.pair_ranks(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or rank(i) != r:
                continue
            j = after[i]
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (i, before[i]):
                if k >= 0 and (x := rank(k)) is not None and x >= 0:
                    heapq.heappush(heap, (x, k))
        return np.array([x for x in ids if x >= 0], np.int64)

    def _learn(self, pieces: list[str]) -> None:
        coded = [p.encode("utf-8", "replace") for p in pieces]
        buckets: dict[int, list[int]] = {}
        for i, (p, b) in enumerate(zip(pieces, coded)):
            if b in self.ranks:
                self.cache[p] = struct.pack("<I", self.ranks[b])
            elif len(b) > LONG:
                self.cache[p] = self.encode_long(b).astype("<u4").tobytes()
            else:
                buckets.setdefault(-(-len(b) // 4), []).append(i)
        for found in buckets.values():
            for at in range(0, len(found), BATCH_PIECES):
                part = found[at : at + BATCH_PIECES]
                self.cache.update(zip([pieces[i] for i in part], self.encode_bucket([coded[i] for i in part])))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        seen = set().union(*split)
        new = seen.difference(self.cache)
        if len(self.cache) + len(new) > CACHE_PIECES:  # what this batch needs stays; a batch has about BATCH_CHARS
            self.cache.clear()
            new = seen
        self._learn(list(new))
        return [b"".join(map(self.cache.__getitem__, s)) for s in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def tokenizer(ranks_path: str, pattern: str) -> ByteBpe:
    """One for each Python worker."""
    if (ranks_path, pattern) not in _LOADED:
        _LOADED[ranks_path, pattern] = ByteBpe(ranks_path, pattern)
    return _LOADED[ranks_path, pattern]


#: Characters that are tokenized together.
BATCH_CHARS = 1 << 20


def _parts(texts):
    """Runs of rows with about BATCH_CHARS characters."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= BATCH_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit integers) of each row."""
    return _encoded(docs, ranks_path, pattern, text, doc_id, "doc_id long, ids binary", lambda bpe, ids: {"ids": ids})


def _encoded(docs, ranks_path, pattern, text, doc_id, schema, columns):
    def encoded(batches):
        bpe = tokenizer(ranks_path, pattern)
        for pdf in batches:
            at = 0
            for part in _parts(["" if t is None else t for t in pdf["t"]]):
                out = pdf[["doc_id"]].iloc[at : at + len(part)]
                at += len(part)
                yield out.assign(**columns(bpe, bpe.encode_batch(part)))

    return fresh(docs, doc_id, text).toDF("doc_id", "t").mapInPandas(encoded, schema)


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encode() and decode() of each row in one pass."""

    def digests(bpe, ids):
        return {
            "n_tokens": [len(x) // 4 for x in ids],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids],
        }

    return _encoded(docs, ranks_path, pattern, "text", "doc_id", "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), *default_ranks())


QUERIES = {"op7_bpe": op7_bpe}
ORACLE_SQL: dict[str, str] = {}
