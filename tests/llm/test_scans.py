"""Periodic runs, decontamination and vector codes against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tests.conftest import same_rows
from tests.llm.cases import DOC, documents, frame
from vitrine.llm import codes, decontaminate, periodic, registry

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def slow_runs(words, least=6, power=4):
    """(start, length, period) by trying every period."""
    found, n = [], len(words)
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, power * q):
                smaller = any(all(words[k] == words[k + p] for k in range(i, j + q - p)) for p in range(1, q))
                if not smaller:
                    found.append((i, j + q - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def slow_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, text):
    words, h = WORDS.findall(text or ""), zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n and doc_id is not None:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_runs_of_random_words():
    rng = random.Random(4)
    cases = [[], [1], [1] * 5, [1] * 6, [1, 2] * 3, [1, 2] * 4, [1, 2, 3] * 4 + [1, 2] * 8 + [1], [1, 1, 2] * 9, [1, 2, 1, 2, 3] * 5]
    for _ in range(600):
        root = [rng.randrange(rng.choice((2, 3, 20))) for _ in range(rng.randint(1, 9))]
        word = [rng.randrange(3) for _ in range(rng.randint(0, 12))] + root * rng.randint(1, 9) + root[: rng.randint(0, len(root))]
        cases.append(word + [rng.randrange(2) for _ in range(rng.randint(0, 20))] + root * rng.randint(0, 5))
    owner, start, length, period = periodic.runs_of([w for c in cases for w in c], [len(c) for c in cases])
    got = [[] for _ in cases]
    for d, *run in zip(owner.tolist(), start.tolist(), length.tolist(), period.tolist()):
        got[d].append(tuple(run))
    assert got == [slow_runs(c) for c in cases]
    assert sum(map(len, got)) > 300


def test_long_runs_take_little():
    """One word a hundred thousand times, a long period four times, and a period of two halves that differ in one word."""
    half = list(range(3000))
    words = [7] * 100_000 + [*half] * 4 + ([*half] + [9999] + half[1:]) * 2
    owner, start, length, period = periodic.runs_of(words, [100_000, 12_000, len(words) - 112_000])
    assert list(zip(owner.tolist(), start.tolist(), length.tolist(), period.tolist())) == [(0, 0, 100_000, 1), (1, 0, 12_000, 3000)]


def odd_texts():
    rows = [(i, t) for i, t, *_ in documents()]
    rows += [(i, " ".join(random.Random(i).choices("abc", k=i % 90))) for i in range(100, 400)]
    return rows + [(None, "x y " * 9), (None, None), (7, "same id " * 8), (7, "same id " * 8), (-3, "é日 \t é日\n" * 11)]


def test_periodic_query(spark, tmp_path):
    rows = odd_texts()
    spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, runs string, words string").write.parquet(str(tmp_path / "documents.parquet"))
    query = registry.queries()["op11_periodic_runs"]
    got = sorted(map(str, (tuple(r) for r in query(spark, str(tmp_path)).collect())))
    want = []
    for doc_id, text in rows:
        words = planted(doc_id, text)
        runs = slow_runs(words) if len(words) < 2000 else []
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, digest(lines), digest(slow_collapsed(words, runs))))
    assert got == sorted(map(str, want)) and sum(w[1] for w in want) > 20
    empty = periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0


def test_periodic_batches_do_not_matter(spark, monkeypatch):
    df = spark.createDataFrame(odd_texts(), "doc_id long, text string").coalesce(1)
    whole = sorted(map(str, periodic.periodic_runs(df).collect()))
    monkeypatch.setattr(periodic, "BATCH_WORDS", 50)
    assert sorted(map(str, periodic.periodic_runs(df).collect())) == whole


SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def slow_contamination(docs, items, width=10):
    split = [(i, SPLIT.findall(lower(t))) for i, t in items]
    windows = {}
    for i, w in split:
        n = min(width, len(w))
        for j in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[j : j + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, met = SPLIT.findall(lower(t)), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                ids = windows.get(tuple(w[j : j + n]))
                if ids is not None:
                    hit |= set(range(j, j + n))
                    met |= {str(i) for i in ids if i is not None}
        out.append((d, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(map(str, out))


def leaked():
    rng = random.Random(8)
    vocabulary = ["a", "the", "Straße", "É", "日本", "x1", "word", "Other", "longerword" * 3, "b2"]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [(i, text(rng.randint(10, 30))) for i in range(30)]
    items += [(30, "Short Item, here"), (31, "z"), (32, ""), (33, None), (None, "an item without any id but with more than ten words"), (3, "a second row of item three which is quite long too")]
    items += [(40 + i, "shared by many: " + items[0][1]) for i in range(5)]
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)]
    for i in range(40, 120):
        part = items[rng.randrange(len(items))][1] or ""
        cut = rng.randint(0, 3)
        docs.append((i, text(rng.randint(0, 9)) + rng.choice([" ", "\n", ", ", "-"]) + part[cut:].upper().replace("SS", "ß") + rng.choice(["", "!", " z ", "z"]) + text(rng.randint(0, 9))))
    docs += [(5, items[1][1]), (None, items[2][1] + "\0" + items[3][1]), (None, None), (200, ""), (201, "ÀÉ " + items[4][1] + "\x7f" + items[5][1] * 40), (202, " ".join(t or "" for _, t in items))]
    return docs, items


@pytest.mark.parametrize("shard_bytes", [1 << 24, 4000])
def test_contamination(spark, tmp_path, monkeypatch, shard_bytes):
    monkeypatch.setattr(decontaminate.contamination, "__defaults__", (decontaminate.WIDTH, shard_bytes))
    monkeypatch.setattr(decontaminate, "STRETCH", 64)
    docs, items = leaked()
    spark.createDataFrame([(*r, "clash", "clash") for r in docs], "doc_id long, text string, row string, items string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, window string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(str(tuple(r)) for r in registry.queries()["op12_decontaminate"](spark, str(tmp_path)).collect())
    assert got == slow_contamination(docs, items)
    assert sum("True" in r for r in got) > 60 and sum("False" in r for r in got) > 20


def test_contamination_of_nothing(spark):
    docs, items = (spark.createDataFrame(r, s) for r, s in zip(leaked(), ("doc_id long, text string", "item_id long, text string")))
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert {(len(r["hits"]), len(r["items"])) for r in decontaminate.contamination(docs, items.limit(0)).collect()} == {(0, 0)}


def test_search_finds_every_place():
    """Patterns that overlap each other and themselves, of all lengths, at every place of a stretch."""
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 4)
        word = lambda: rng.choice(["a", "aa", "aaa", "ab", "b"])
        patterns = list({(" " + " ".join(word() for _ in range(n)) + " ").encode() for _ in range(rng.randint(1, 6))})
        texts = [" ".join(word() for _ in range(rng.randint(0, 300))).encode() for _ in range(4)]
        data = decontaminate.normalised(texts)
        spaces = np.flatnonzero(data == 32)
        got = sorted(decontaminate.WuManber(patterns, n).occurrences(data, spaces))
        flat = data.tobytes()
        assert got == sorted((int(np.searchsorted(spaces, i)), p) for p in patterns for i in range(len(flat)) if flat.startswith(p, i))


def slow_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Codebooks and (id, label, code, error) in Python's integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = next((len(v) for _, v, _ in rows if v and len(v) % parts == 0), 0)
    whole = [[math.floor(scale * x) if abs(x) < 2**52 else int(x) * scale for x in v] for _, v, _ in rows]
    cut = [[w[p * dim // parts : (p + 1) * dim // parts] for p in range(parts)] if len(w) == dim and dim else None for w in whole]
    used = [c for c in cut if c]
    books = [[c[p] for c in used[:entries]] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    pick = lambda c: [min(range(len(b)), key=lambda e: (apart(x, b[e]), e)) for x, b in zip(c, books)]
    for _ in range(rounds):
        at = [pick(c) for c in used]
        books = [[[sum(col) // len(mine) for col in zip(*mine)] if (mine := [c[p] for c, a in zip(used, at) if a[p] == e]) else old for e, old in enumerate(b)] for p, b in enumerate(books)]
    out = []
    for (i, _, label), c in zip(rows, cut):
        a = pick(c) if c else None
        error = sum(apart(x, b[e]) for x, b, e in zip(c, books, a)) if c else None
        out.append((i, label, "".join(f"{e:02x}" for e in a) if c else None, error if c and error < 2**63 else None))
    return books, out


def test_exact_products():
    rng = np.random.default_rng(2)
    for top in (1, 100, 1 << 20, 1 << 26, 1 << 29):
        a, b = rng.integers(-top, top + 1, (40, 8)), rng.integers(-top, top + 1, (8, 16))
        a[0], b[:, 0] = -top, -top
        assert (codes.exact_product(a, b) == a.astype(object) @ b.astype(object)).all()
    for bits in (3, 22):
        parts = codes.limbs(a, bits)
        assert (sum(p.astype(np.int64) << (bits * i) for i, p in enumerate(parts)) == a).all()


@pytest.mark.parametrize("wild", [1.0, 1e5, 1e12, 1e300])
def test_codes(spark, tmp_path, wild):
    rng = random.Random(6)
    rows = [(i, [rng.choice([rng.gauss(0, 1), 0.25, -0.5]) * (wild if i % 50 == 3 else 1.0) for _ in range(24)], rng.choice([None, 1, 2, 3])) for i in range(140)]
    rows += [(i, rows[i % 7][1], 1) for i in range(200, 260)] + [(None, [0.5] * 24, None), (20, [-0.5] * 24, 2), (20, [-0.5] * 24, 2), (300, [1.0] * 7, 1), (301, [], 1)]
    bad = [(-5, None, 1), (-4, [float("nan")] * 24, 1), (-3, [float("inf")] + [0.0] * 23, 1), (-2, [None] + [0.0] * 23, 1)]
    spark.createDataFrame([(*r, "clash", "clash") for r in rows + bad], "vec_id long, embedding array<double>, label int, code string, error string").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    books, want = slow_codes(rows)
    sums = {}
    for _, label, _, e in want:
        if e is not None:
            sums[label] = sums.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    fits = lambda x: x if x is None or x < 2**63 else None
    got = sorted(str(tuple(r)) for r in registry.queries()["op13_vector_codes"](spark, str(tmp_path)).collect())
    assert got == sorted(str((i, c, e, fits(sums.get(label)), digest)) for i, label, c, e in want)


def test_codes_of_few_and_none(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, label int"
    few = [(2, [0.5, -0.25] * 4, None), (1, [0.75] * 8, None)]
    df = spark.createDataFrame(few, schema)
    found, books = codes.compress(df)
    assert sorted(map(tuple, found.collect())) == [(1, None, "00" * 8, 0, 0), (2, None, "01" * 8, 0, 0)]
    assert [len(b) for b in books] == [2] * 8
    assert codes.compress(df.limit(0))[0].count() == 0


@pytest.mark.parametrize("name", ["op12_decontaminate", "op13_vector_codes"])
def test_sql(spark, sf, duck, name):
    same_rows(registry.queries()[name](spark, sf), duck.sql(registry.oracle_sql()[name]))


def test_clashing_columns(spark):
    df = frame(spark)
    assert periodic.periodic_runs(df).count() == decontaminate.contamination(df, df.withColumnRenamed("doc_id", "item_id")).count() == df.count()
    assert DOC
