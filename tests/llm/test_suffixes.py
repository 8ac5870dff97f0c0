"""Suffix order, matches, longest previous factors and greedy factors against brute force."""

import random

import numpy as np

from vitrine.llm import segments, substring_dedup, suffix_dedup
from vitrine.llm.suffixes import Suffixes, smaller


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def pieces(rng):
    k = rng.choice([1, 2, 3, 300])
    found = [[rng.randrange(k) for _ in range(rng.randint(1, 60))] for _ in range(rng.randint(1, 6))]
    return found + found[: rng.choice([0, 2])]


def test_order_and_previous_factors():
    rng = random.Random(1)
    for t in range(120):
        given = pieces(rng)
        tails = [p[i:] for p in given for i in range(len(p))]
        order = Suffixes([x for p in given for x in p], [len(p) for p in given])
        assert [tails[i] for i in order.order.tolist()] == sorted(tails)
        value = np.array([rng.randrange(10) for _ in tails]) if t % 2 else np.arange(len(tails))
        length, source = order.previous_factors(value)
        for i, tail in enumerate(tails):
            assert length[i] == max((common(tail, tails[j]) for j in range(len(tails)) if value[j] < value[i]), default=0)
            if length[i]:
                assert value[source[i]] < value[i] and common(tail, tails[source[i]]) == length[i]
        enough, _ = order.previous_factors(value, 9)
        assert [x for x in enough if x >= 9] == [x for x in length if x >= 9]


def test_smaller_places():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 300):
        values = rng.integers(0, 20, n) if n != 50 else np.arange(50)
        low = rng.integers(0, 9, n)
        for step in (-1, 1):
            want = [next((j for j in (range(i - 1, -1, -1) if step < 0 else range(i + 1, n)) if values[j] < values[i]), -1) for i in range(n)]
            near, least = smaller(values, step, low.copy())
            assert near.tolist() == want
            for i, j in enumerate(want):
                if j >= 0:
                    assert least[i] == min(low[j + 1 : i + 1] if step < 0 else low[i:j])


def test_longest_factors_of_windows():
    """The lengths of previous and next factors, not only which windows repeat."""
    rng = random.Random(2)
    for _ in range(60):
        base = bytes(rng.choice(b"ab\0") for _ in range(80))
        contents = [base[rng.randint(0, 40) : rng.randint(30, 80)] + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 6))]
        starts, previous, source = suffix_dedup.longest_factors(contents, 8)
        tails = [c[i:] for c in contents for i in range(len(c))]
        assert starts.tolist() == [sum(map(len, contents[:k])) for k in range(len(contents))]
        for i, tail in enumerate(tails):
            want = max((common(tail, tails[j]) for j in range(i)), default=0)
            assert previous[i] == (want if want >= 8 else 0)
            elsewhere = len(tail) >= 8 and any(t[:8] == tail[:8] for j, t in enumerate(tails) if j != i)
            assert (previous[i] > 0 or source[i]) == elsewhere


def test_greedy_factors():
    rng = random.Random(3)
    for _ in range(80):
        texts = [[b"w%d" % rng.randrange(3) for _ in range(rng.randint(1, 40))] for _ in range(rng.randint(1, 7))]
        texts += texts[:1]
        docs = [rng.randrange(4) for _ in texts]
        reference = substring_dedup.Reference([b" ".join(t) for t in texts], docs, 5)
        want, runs, begin = [], reference.parse(), 0
        for i, words in enumerate(texts):
            longest = [max((common(words[at:], t[j:]) for t, d in zip(texts, docs) if d < docs[i] for j in range(len(t))), default=0) for at in range(len(words))]
            at = 0
            while at < len(words):
                if longest[at] >= 5:
                    want.append((begin + at, longest[at]))
                    at += longest[at] - 4
                else:
                    at += 1
            own = runs.get(i, [])
            held = {tuple(t[j : j + 5]) for t, d in zip(texts, docs) if d < docs[i] for j in range(len(t) - 4)}
            assert {x for s, e in zip(own[::2], own[1::2]) for x in range(s, e)} == {j for j in range(len(words) - 4) if tuple(words[j : j + 5]) in held}
            begin += len(words)
        assert reference.factors() == want


def test_blocks_keep_keys_whole():
    import pandas as pd

    rng = random.Random(4)
    keys = sorted(rng.randrange(40) for _ in range(300))
    content = [b"x" * rng.randint(1, 30) for _ in keys]
    batches = [pd.DataFrame({"deal": keys[i : i + 37], "content": content[i : i + 37]}) for i in range(0, 300, 37)]
    for size in (1, 100, 10_000):
        got = list(segments.blocks(iter(batches), "deal", size))
        assert [k for b in got for k in b["deal"].tolist()] == keys and [c for b in got for c in b["content"]] == content
        assert len({k for b in got for k in set(b["deal"].tolist())}) == sum(len(set(b["deal"].tolist())) for b in got)
    assert list(segments.blocks(iter([]), "deal", 5)) == []


def test_window_hashes_meet_with_equal_windows():
    text = b" ".join(b"w%d" % (i % 7) for i in range(30))
    hashes = [tuple(h.values()) for h in segments.window_hashes(text, "words", 13)]
    assert len(hashes) == 18 and len(set(hashes)) == 7 and hashes[0] == hashes[7]
    assert len(segments.window_hashes(b"x" * 250, "bytes", 200)) == 51
