"""Blocks that are compared in parts give what they give at once, in little memory."""

import random
import subprocess
import sys

import numpy as np
import pytest

from vitrine.llm import parts, segments, substring_dedup, suffix_dedup


def slow(contents, docs, kind, width, by_place):
    """(later, met) of each token by comparing all windows."""
    tokens = [list(c) if kind == "bytes" else c.split(b" ") for c in contents]
    seen, offsets = {}, np.cumsum([0] + [len(t) for t in tokens])
    for k, t in enumerate(tokens):
        for i in range(len(t) - width + 1):
            seen.setdefault(tuple(t[i : i + width]), []).append((offsets[k] + i, docs[k]))
    later, met = np.zeros(offsets[-1], bool), np.zeros(offsets[-1], bool)
    for places in seen.values():
        least = min(p if by_place else d for p, d in places)
        for p, d in places:
            later[p] = (p if by_place else d) > least
            met[p] = len(places) > 1
    return later, met


def factors(width):
    def compare(contents, _):
        _, previous, source = suffix_dedup.longest_factors(contents, width)
        return previous > 0, source

    return compare


def reference(width):
    return lambda contents, docs: (substring_dedup.Reference(contents, docs, width).seen(), None)


@pytest.mark.parametrize("part", [1, 60, 1 << 20])
@pytest.mark.parametrize("bits", [64, 3])
def test_parts_change_nothing(monkeypatch, part, bits):
    """Also where many windows share a hash."""
    real = segments.gram_hashes
    if bits < 64:
        monkeypatch.setattr(parts, "gram_hashes", lambda h, w: (real(h, w) >> np.uint64(7)) % np.uint64(1 << bits) << np.uint64(50))
    monkeypatch.setattr(parts, "SLICE", 40)
    monkeypatch.setattr(parts, "ROUND", 16)
    rng = random.Random(part + bits)
    for _ in range(40):
        line = bytes(rng.choice(b"abcd") for _ in range(30))
        texts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 6))) + line[rng.randint(0, 9) : rng.randint(20, 30)] + bytes(rng.choice(b"xyz") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 25))]
        offsets, later, source = parts.repeated(texts, np.arange(len(texts)), "bytes", 8, factors(8), True, part)
        want, met = slow(texts, range(len(texts)), "bytes", 8, True)
        assert (later == want).all() and ((later | source) == met).all()
        assert offsets.tolist() == np.cumsum([0] + [len(t) for t in texts])[:-1].tolist()
        words = [" ".join(chr(c) for c in t).encode() for t in texts if t]
        docs = sorted(rng.randrange(6) for _ in words)
        _, later, _ = parts.repeated(words, docs, "words", 5, reference(5), False, part)
        assert (later == slow(words, docs, "words", 5, False)[0]).all()


def test_nothing_to_compare():
    for contents in ([], [b"short"], [b"x" * 300]):
        _, later, source = parts.repeated(contents, np.arange(len(contents)), "bytes", 200, factors(200), True)
        assert later.sum() == max(0, sum(map(len, contents)) - 200) and len(source) == sum(map(len, contents))


MEASURE = """
import random, resource, sys
import numpy as np
from vitrine.llm import parts, suffix_dedup, substring_dedup
rng = random.Random(1)
n, kind = int(sys.argv[1]), sys.argv[2]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
if kind == "bytes":
    line = bytes(rng.choice(b"abcdefgh ") for _ in range(260))
    contents = [rng.randbytes(120).hex().encode()[:120] + line + rng.randbytes(120).hex().encode()[:120] for _ in range(n)]
    def compare(c, d):
        _, previous, source = suffix_dedup.longest_factors(c, 200)
        return previous > 0, source
    _, later, _ = parts.repeated(contents, np.arange(n), "bytes", 200, compare, True)
    assert later.sum() >= (n - 1) * 61
else:
    line = " ".join(rng.choice("the of and to in is".split()) for _ in range(20))
    contents = [" ".join([*(rng.randbytes(3).hex() for _ in range(12)), line, *(rng.randbytes(3).hex() for _ in range(12))]).encode() for _ in range(n)]
    _, later, _ = parts.repeated(contents, np.arange(n), "words", 13, lambda c, d: (substring_dedup.Reference(c, d, 13).seen(), None), False)
    assert later.sum() >= (n - 1) * 8
own = sum(map(len, contents)) + 60 * n
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024, own >> 20)
"""


@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_memory_of_a_common_line(kind):
    """As many contexts of one line as a key can bring into a block."""
    done = subprocess.run([sys.executable, "-c", MEASURE, str(segments.FULL), kind], capture_output=True, text=True, check=True, timeout=900)
    used, own = map(int, done.stdout.split())
    assert used < 300 + own, (used, own)
