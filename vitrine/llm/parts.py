"""Comparison of a block of segments in parts of a bounded size.

A suffix order takes some 150 bytes of memory for each token, so a block with all contexts of a common line can't be sorted
at once. Only windows that occur twice matter, and each of them only has to meet the first of its kind:

1. Window hashes tell which windows may occur twice: a table of bits by hash sets most others aside, and those that are left
   are compared in several rounds, each for one share of the hashes. So memory is a few bytes a token.
2. The stretches of such windows are cut out. Equal stretches are compared once: all windows of a later one occur before.
3. The stretches are compared part by part by the caller's method, together with the first place of each window of the part
   that lies before it. A part is halved until both fit.
4. Windows that should have met by their hash and didn't (two contents with one hash) are compared by their bytes.

So results are those of comparing the block at once.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np

from vitrine.llm.segments import _word_hashes, byte_hashes, gram_hashes

#: Tokens of a part, with the first places of its windows, and bytes that are hashed together.
PART = {"bytes": 1 << 18, "words": 1 << 15}
SLICE = 1 << 20
#: Bits of the table of seen hashes, and windows that are sorted in one round.
BITS, ROUND = 24, 1 << 22


def _slices(contents: list[bytes]):
    """Ranges of contents with about SLICE bytes."""
    begin, size = 0, 0
    for i, c in enumerate(contents):
        if size and size + len(c) > SLICE:
            yield begin, i
            begin, size = i, 0
        size += len(c)
    if begin < len(contents):
        yield begin, len(contents)


def token_hashes(contents: list[bytes], kind: str):
    """Hashes of the tokens of all contents, one after the other."""
    if kind == "bytes":
        return byte_hashes(np.frombuffer(b"".join(contents), np.uint8))
    data = np.frombuffer(b" " + b" ".join(contents) + b" ", np.uint8)
    spaces = np.flatnonzero(data == 32)
    return _word_hashes(data, spaces[:-1] + 1, spaces[1:])


class Block:
    """Segments laid end to end, and what is needed to find their windows."""

    def __init__(self, contents: list[bytes], kind: str, width: int):
        self.contents, self.kind, self.width = contents, kind, width
        size = (lambda c: len(c)) if kind == "bytes" else (lambda c: c.count(b" ") + 1)
        self.lengths = np.fromiter(map(size, contents), np.int64, len(contents))
        self.offsets = np.cumsum(self.lengths) - self.lengths

    def windows(self):
        """(places, hashes) of all windows, slice by slice."""
        for i, j in _slices(self.contents):
            n = np.maximum(self.lengths[i:j] - self.width + 1, 0)
            if n.any():
                own = self.offsets[i:j] - self.offsets[i]
                at = np.repeat(own - (np.cumsum(n) - n), n) + np.arange(n.sum())
                yield at + self.offsets[i], gram_hashes(token_hashes(self.contents[i:j], self.kind), self.width)[at]

    def twice(self):
        """(places, first) of the windows whose hash occurs twice, in order: first is the first place with that hash."""
        total = int(self.lengths.sum())
        place_type = np.int32 if total < 1 << 31 else np.int64
        out = []
        for place, h in self._likely(place_type):
            by_hash = np.argsort(h, kind="stable")  # equal hashes in the order of their places
            h, place = h[by_hash], place[by_hash]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            more = ~new
            more[:-1] |= ~new[1:]
            first = place[np.maximum.accumulate(np.where(new, np.arange(len(h), dtype=place_type), 0))]
            out.append((place[more], first[more]))
        if not sum(len(p) for p, _ in out):
            return np.zeros(0, place_type), np.zeros(0, place_type)
        places, firsts = zip(*out)
        place = np.concatenate(places)
        by_place = np.argsort(place)
        place = place[by_place]
        return place, np.concatenate(firsts)[by_place]

    def _likely(self, place_type):
        """(places, hashes) of windows, those with one hash together and in order, without most of those that stand alone."""
        if sum(map(len, self.contents)) <= SLICE:  # all at once
            yield from ((at.astype(place_type), h) for at, h in self.windows())
            return
        down, seen, again, n = np.uint64(64 - BITS), np.zeros(1 << BITS, bool), np.zeros(1 << BITS, bool), 0
        for _, h in self.windows():
            slot = np.sort((h >> down).astype(np.int32))
            again[slot[1:][slot[1:] == slot[:-1]]] = True
            again[slot[seen[slot]]] = True
            seen[slot] = True
            n += len(h)
        del seen
        rounds = -(-n // ROUND)
        for r in range(rounds):  # hashes are computed again for each round, as all don't fit at once
            found = []
            for at, h in self.windows():
                on = again[(h >> down).astype(np.int32)]
                if rounds > 1:
                    on &= h % np.uint64(rounds) == r
                found.append((at[on].astype(place_type), h[on]))
            yield tuple(np.concatenate(x) for x in zip(*found))

    def owner(self, at):
        return np.searchsorted(self.offsets, at, "right") - 1

    def stretches(self, at):
        """(first, last, start, end) of the stretches that the windows at these places (in order) cover: which of them
        are the first and the last window of each, and its tokens."""
        new = np.ones(len(at), bool)
        new[1:] = np.diff(at) > self.width
        heads = np.searchsorted(at, self.offsets)  # a segment's first window may follow at once on the last one before
        heads = heads[heads < len(at)]
        new[heads[np.isin(at[heads], self.offsets)]] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        return first, last, at[first], at[last] + self.width

    def content(self, start, end) -> list[bytes]:
        """The bytes of runs of tokens, none across segments."""
        owner = self.owner(start)
        out = []
        for i, s, e in zip(owner.tolist(), (start - self.offsets[owner]).tolist(), (end - self.offsets[owner]).tolist()):
            c = self.contents[i]
            out.append(c[s:e] if self.kind == "bytes" else b" ".join(c.split(b" ")[s:e]))
        return out


def repeated(contents: list[bytes], docs, kind: str, width: int, compare, by_place: bool, part: int | None = None):
    """(offsets, later, source): where each segment starts among all tokens; at which tokens a window starts that also starts
    earlier; and at which such windows were found. Segments are in the order of docs. Earlier is a smaller doc, or with
    by_place any place before. compare takes stretches and their docs, and gives later and source (or None) of their tokens."""
    block, part = Block(contents, kind, width), part or PART[kind]
    docs, total = np.asarray(docs), int(block.lengths.sum())
    later, source = np.zeros(total, bool), np.zeros(total, bool)
    at, first_place = block.twice()
    if not len(at):
        return block.offsets, later, source
    rank = (lambda p: p) if by_place else (lambda p: docs[block.owner(p)])
    first, last, start, end = block.stretches(at)
    known: dict[bytes, int] = {}
    same = np.fromiter((known.setdefault(c, i) for i, c in enumerate(block.content(start, end))), np.int64, len(start))
    del known
    own = np.flatnonzero(same == np.arange(len(same)))
    edges = np.searchsorted(np.cumsum((end - start)[own]), np.arange(part, int((end - start)[own].sum()) + part, part))
    todo = [p for p in np.split(own, np.unique(edges[:-1] + 1)) if len(p)][::-1]
    while todo:
        these = todo.pop()
        windows = np.concatenate([np.arange(first[i], last[i] + 1) for i in these.tolist()])
        before = np.unique(first_place[windows])
        before = before[~np.isin(before, at[windows])]
        if len(before):
            _, _, s, e = block.stretches(before)
        else:
            s = e = before
        if len(these) > 1 and (end - start)[these].sum() + (e - s).sum() > 2 * part:
            todo += [these[len(these) // 2 :], these[: len(these) // 2]]
            continue
        s, e = np.concatenate([s, start[these]]), np.concatenate([e, end[these]])
        in_order = np.argsort(s, kind="stable")
        s, e = s[in_order], e[in_order]
        new, where = compare(block.content(s, e), rank(s))
        n = e - s
        place = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(n.sum())
        later[place[new]] = True
        if where is not None:
            source[place[where]] = True
    ranks = rank(start).tolist()
    for i in np.flatnonzero(same != np.arange(len(same))).tolist():  # equal to an earlier stretch
        one = same[i]
        if by_place or ranks[i] > ranks[one]:
            later[at[first[i] : last[i] + 1]] = True
            source[at[first[one] : last[one] + 1]] = True
        else:
            later[at[first[i] : last[i] + 1]] = later[at[first[one] : last[one] + 1]]
    astray = []
    for i in range(0, len(at), SLICE):
        a, f = at[i : i + SLICE], first_place[i : i + SLICE]
        missed = np.flatnonzero(~later[a])
        astray.append(np.unique(f[missed][rank(a[missed]) > rank(f[missed])]))
    astray = np.unique(np.concatenate(astray))
    if len(astray):  # one hash, several contents
        on = at[np.isin(first_place, astray)]
        firsts: dict[bytes, int] = {}
        places: dict[bytes, list[int]] = defaultdict(list)
        for p, c in zip(on.tolist(), block.content(on, on + width)):
            firsts.setdefault(c, p)
            places[c].append(p)
        for c, ps in places.items():
            ps = np.array(ps)
            after = ps[rank(ps) > rank(np.array([firsts[c]]))[0]]
            later[after] = True
            if len(after):
                source[firsts[c]] = True
    return block.offsets, later, source
