"""Suffix order of a block of token sequences by prefix doubling, the lengths of matches in it, and longest previous factors.

The pieces of a block are laid end to end. A suffix ends where its piece ends, so matches never cross pieces; where one
suffix is a prefix of another, it is the smaller. Each level holds the ranks of all suffixes by their first `reach`
tokens, and the next level sorts those that are still tied by pairs of ranks. The levels give the length of the match
of any two suffixes as well: whoever has equal ranks at a level agrees in that many tokens.
"""

from __future__ import annotations

import numpy as np


class Suffixes:
    """The suffix order of tokens (integers from 0) cut into pieces of the given lengths."""

    def __init__(self, tokens, lengths):
        self.tokens = tokens = np.asarray(tokens)
        lengths = np.asarray(lengths, np.int64)
        n = len(tokens)
        ends = np.cumsum(lengths)
        #: Tokens from each position up to the end of its piece.
        self.left = np.repeat(ends, lengths) - np.arange(n)
        base = int(tokens.max(initial=0)) + 2
        self.first = max(1, int(63 / np.log2(base)))  # so many tokens fit into one number
        key = np.zeros(n, np.int64)
        for j in range(min(self.first, n)):
            key *= base
            key[: n - j] += np.where(self.left[: n - j] > j, tokens[j:].astype(np.int64) + 1, 0)
        order = np.argsort(key)
        new = np.ones(n, bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        self.levels, reach = [(self.first, rank)], self.first
        slots = np.arange(n)
        while True:
            # ties of one rank end together or not at all: their first `reach` tokens are equal, the padding too
            tied = ~new
            tied[:-1] |= ~new[1:]
            slots = slots[tied & (self.left[order[slots]] >= reach)]
            if not len(slots):
                break
            at = order[slots]
            behind = np.where(self.left[at] > reach, rank[np.minimum(at + reach, n - 1)].astype(np.int64) + 1, 0)
            key = rank[at].astype(np.int64) * (n + 1) + behind
            by_key = np.argsort(key)
            at, key = at[by_key], key[by_key]
            order[slots] = at
            new = np.ones(len(slots), bool)
            new[1:] = key[1:] != key[:-1]
            rank = rank.copy()
            rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
            reach *= 2
            self.levels.append((reach, rank))
        self.order = order

    def adjacent(self, at_least: int = 0):
        """Length of the match of each suffix, in suffix order, with the one before; 0 where it is surely under at_least."""
        order, last = self.order, len(self.tokens) - 1
        length = np.zeros(len(order), np.int32)
        known = [rank for reach, rank in self.levels if reach <= at_least][-1:]
        pairs = np.arange(1, len(order))
        for rank in known:
            pairs = pairs[rank[order[1:]] == rank[order[:-1]]]
        a, b = order[pairs - 1], order[pairs]
        most, found = np.minimum(self.left[a], self.left[b]), np.zeros(len(pairs), np.int64)
        for reach, rank in reversed(self.levels):
            step = np.where(rank[a] == rank[b], reach, 0)
            found += step
            a, b = np.minimum(a + step, last), np.minimum(b + step, last)
        more = np.arange(len(pairs))
        for _ in range(self.first - 1):
            more = more[(found[more] < most[more]) & (self.tokens[a[more]] == self.tokens[b[more]])]
            found[more] += 1
            a[more], b[more] = np.minimum(a[more] + 1, last), np.minimum(b[more] + 1, last)
        length[pairs] = np.minimum(found, most)
        return length

    def previous_factors(self, value, at_least: int = 0):
        """For each position, the longest match with a position of smaller value, and where that is (-1: none); a match
        under at_least tokens may be given as 0.

        Among the suffixes of smaller value, the nearest before and after in suffix order match longest; their matches are
        the least of the adjacent ones between."""
        order, adjacent = self.order, self.adjacent(at_least)
        length, source = np.zeros(len(order), np.int64), np.full(len(order), -1)
        value = value[order]
        for step, low in ((-1, adjacent.copy()), (1, np.append(adjacent[1:], np.int32(0)))):
            near, low = smaller(value, step, low)
            here = np.flatnonzero((near >= 0) & (low > length[order]))
            length[order[here]], source[order[here]] = low[here], order[near[here]]
        return length, source


def smaller(values, step: int, low):
    """For each place, the nearest one before (step -1) or after (1) it with a smaller value (-1: none), and the least of
    low over the steps up to there, where low belongs to each place's own step."""
    near = np.arange(len(values)) + step
    near[near == len(values)] = -1
    on = np.arange(len(values))
    while len(on):  # those that are not settled jump to where the place they look at looks
        at = near[on]
        go = (at >= 0) & (values[np.maximum(at, 0)] >= values[on])
        on, at = on[go], at[go]
        low[on], near[on] = np.minimum(low[on], low[at]), near[at]
    return near, low
