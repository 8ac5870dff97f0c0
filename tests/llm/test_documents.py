"""Operators on documents against brute force, over tables with every awkward case."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
import xxhash

from tests.llm.cases import DOC, documents, frame
from vitrine.llm import bpe, mixing, quality, simhash, substring_dedup, suffix_dedup, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = documents()


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def slow_fingerprint(text):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark):
    got = rows(simhash.simhash_groups(frame(spark)))
    fps = {d: slow_fingerprint(t) for d, t, *_ in ROWS}
    assert {d: r["fp"] % (1 << 64) for d, r in got.items()} == fps
    least = {d: d for d in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2:
                    least[a] = least[b] = min(least[a], least[b])
    assert {d: r["component_id"] for d, r in got.items()} == least


def test_simhash_divides_large_shards(spark, monkeypatch):
    """Chains of fingerprints, far over the cap of a shard, keep all their links."""
    monkeypatch.setattr(simhash, "SHARD_CAP", 8)
    fps = sorted({(1 << i) | (1 << j) for i in range(12) for j in range(12)} | {(0xFF << 40) | i for i in range(64)} | {(1 << 60) + (7 << 3 * i) for i in range(15)})
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, name long")
    got = {r["name"]: r["component"] for r in simhash.components(simhash.links(nodes)).collect()}
    least = list(range(len(fps)))
    for _ in range(12):
        for a in range(len(fps)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= 2:
                    least[a] = least[b] = min(least[a], least[b])
    assert {i: got.get(i, i) for i in range(len(fps))} == dict(enumerate(least))


def test_simhash_repeated_and_null_ids(spark):
    """Rows without a doc_id are linked by their fingerprints like all others."""
    texts = ["one two three four five six", "one two three four five six", "something else", "something else", "alone without id", ""]
    ids = [None, 5, 3, 3, None, None]
    got = simhash.simhash_groups(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()
    fps = [slow_fingerprint(t) for t in texts]
    assert sorted((str(r["doc_id"]), r["fp"] % (1 << 64), str(r["component_id"])) for r in got) == sorted(zip(map(str, ids), fps, ["5", "5", "3", "3", "None", "None"]))


def test_op1_query(spark, tmp_path):
    spark.createDataFrame(ROWS, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    got = rows(simhash.op1_simhash(spark, str(tmp_path)))
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: f"{slow_fingerprint(t):016x}" for d, t, *_ in ROWS}


def test_bk_tree_finds_what_a_scan_finds():
    import random

    rng, tree, seen = random.Random(3), simhash.BKTree(), []
    for _ in range(400):
        v = rng.getrandbits(12)
        assert sorted(tree.values[i] for i in tree.near(v, 2)) == sorted(x for x in set(seen) if (x ^ v).bit_count() <= 2)
        tree.add(v)
        seen.append(v)


def slow_removed(tokens, width, bad):
    """Which tokens are in a window for which bad(window) holds."""
    gone = [False] * len(tokens)
    for i in range(len(tokens) - width + 1):
        if bad(tokens[i : i + width]):
            gone[i : i + width] = [True] * width
    return gone


@pytest.mark.parametrize("hot", [(1000, 1 << 17), (2, 1 << 17), (2, 2)])
def test_substring_dedup(spark, monkeypatch, hot):
    from vitrine.llm import segments

    monkeypatch.setattr(segments, "HOT", hot[0])
    monkeypatch.setattr(segments, "FULL", hot[1])
    data = {d: WORDS.findall(t or "") for d, t, *_ in ROWS}
    first = {}
    for d in sorted(data):
        for i in range(len(data[d]) - 12):
            first.setdefault(tuple(data[d][i : i + 13]), d)
    got = rows(substring_dedup.remove_duplicates(frame(spark)))
    for d, w in data.items():
        gone = slow_removed(w, 13, lambda x: first[tuple(x)] < d)
        kept = " ".join(x for x, g in zip(w, gone) if not g).encode()
        assert (got[d]["n_words"], got[d]["n_removed"], bytes(got[d]["kept"])) == (len(w), sum(gone), kept)


@pytest.mark.parametrize("hot", [(1000, 1 << 17), (2, 1 << 17), (2, 2)])
@pytest.mark.parametrize("keep_first", [False, True])
def test_suffix_dedup(spark, monkeypatch, hot, keep_first):
    from vitrine.llm import segments

    monkeypatch.setattr(segments, "HOT", hot[0])
    monkeypatch.setattr(segments, "FULL", hot[1])
    data = {d: (t or "").encode() for d, t, *_ in ROWS}
    data[60] = data[60][:5000]
    count = Counter(b[i : i + 200] for b in data.values() for i in range(len(b) - 199))
    table = [(d, None if t is None else data[d].decode("utf-8", "ignore") if d == 60 else t, lang, s, n) for d, t, lang, s, n in ROWS]
    data[60] = data[60].decode("utf-8", "ignore").encode()
    count = Counter(b[i : i + 200] for b in data.values() for i in range(len(b) - 199))
    got = rows(suffix_dedup.remove_repeats(frame(spark, table), keep_first=keep_first))
    seen: set = set()
    for d in sorted(data):
        b, gone = data[d], bytearray(len(data[d]))
        for i in range(len(b) - 199):
            w = b[i : i + 200]
            if (w in seen) if keep_first else count[w] > 1:
                gone[i : i + 200] = b"\1" * 200
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert bytes(got[d]["kept"]) == kept and got[d]["n_bytes"] == len(b)
        assert sum(e - s for s, e in zip(got[d]["removed"][::2], got[d]["removed"][1::2])) == sum(gone)


def test_repeats_as_text_leave_no_broken_characters(spark):
    text = "é" * 400
    df = spark.createDataFrame([(1, "x" + text, None, None, 1), (2, text + "yz", None, None, 1)], DOC)
    got = rows(suffix_dedup.remove_repeats(df, as_text=True, carry=("lang", "n_chars")))
    assert got[2]["kept"].endswith("yz") and "\ufffd" not in got[2]["kept"] and got[1]["carried"]["n_chars"] == 1


def test_quality_features(spark):
    got = rows(quality.quality_verdicts(frame(spark)))
    for d, t, *_ in ROWS:
        w = WORDS.findall(t or "")
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeat = slow_removed(w, 5, lambda x: grams[tuple(x)] > 1)
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), sum(repeat))
        assert r["base_failed"] == (len(w) < 10 or 100 * sum(repeat) > 20 * len(w))


def test_cascade_order_changes_nothing(spark):
    base = quality.base_features(frame(spark).select("doc_id", "text"))
    rules = quality.default_rules()
    verdicts = [sorted(map(tuple, base.select("doc_id", quality.cascade(rules, order).alias("k")).collect())) for order in (list(rules), list(rules)[::-1])]
    assert verdicts[0] == verdicts[1]
    assert sorted(quality.cascade_order(base, rules, 50)) == sorted(rules)


def test_cascade_orders_by_rejection_per_cost(spark):
    """A rule that rejects much goes before one that rejects little; a null rule rejects nothing; repeated rows are alike."""
    from pyspark.sql import functions as F

    base = quality.base_features(spark.createDataFrame(ROWS + ROWS[:5] + [(None, "x " * 30, None, None, 1)], DOC).select("doc_id", "text"))
    rules = {"never": F.lit(None).cast("boolean"), "often": F.col("n_words") >= 0, "seldom": F.col("n_words") == 17}
    assert quality.cascade_order(base, rules)[0] == "often"
    judged = quality.quality_verdicts(base.select("doc_id", "text"), {"never": rules["never"]}).collect()
    assert len(judged) == len(ROWS) + 6 and all(r["kept"] == (not r["base_failed"]) for r in judged)


def test_bpe_is_tiktoken(spark):
    import tiktoken

    path, pattern = bpe.default_ranks()
    own = bpe.tokenizer(path, pattern)
    want = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})
    got = rows(bpe.encode(frame(spark), path, pattern))
    odd = ["<|endoftext|> x", "a" * 1000, "²³½ \u2028x\x1cy", " " * 300, "né e\u0301 ١٢", "don't WE'LL"]
    for i, t in [(d, t or "") for d, t, *_ in ROWS] + list(enumerate(odd, 1000)):
        ids = bytes(got[i]["ids"]) if i < 1000 else own.encode_batch([t])[0]
        assert [int.from_bytes(ids[j : j + 4], "little") for j in range(0, len(ids), 4)] == want.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_fast_pattern_agrees_character_by_character():
    import regex

    slow = regex.compile(bpe.USUAL).findall
    for c in map(chr, range(0x250)):
        if not bpe.SIMPLE(c):
            for t in (c, f"a{c}", f"1{c}", f" {c}", f"#{c}", f"{c}a", f"{c}{c} ", f"{c} #"):
                assert bpe.FAST(t) == slow(t)


def slow_targets(sizes):
    total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    fixed: dict = {}
    while True:
        left, w = total - sum(fixed.values()), sum(weight[s] for s in names if s not in fixed)
        share = {s: left * weight[s] / w for s in names if s not in fixed}
        over = {s: 3 * sizes[s] for s in share if share[s] > 3 * sizes[s]}
        if not over:
            return fixed | share
        fixed |= over


def test_mixing(spark):
    df = frame(spark)
    got = mixing.mix(df).collect()
    sizes = defaultdict(int)
    for _, t, _, s, _ in ROWS:
        sizes[s] += len(WORDS.findall(t or ""))
    want, taken, shards = slow_targets(sizes), Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, r["target"])
        words = sum(x["words"] for x in r["draws"])
        assert words <= 3 * r["size"]
        taken[r["source"]] += words
        shards.update(x["shard"] for x in r["draws"])
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes) and set(shards) <= set(range(mixing.SHARDS))
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_splitting_tree_keeps_its_quotas():
    counts = [7, 0, 30, 5]
    tree = mixing.splitting_tree(counts, 6, 4)
    assert [sum(c) for c in zip(*tree)] == counts and {sum(s) for s in tree} <= {7}
    assert tree == mixing.splitting_tree(counts, 6, 4) != mixing.splitting_tree(counts, 6, 5)


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    from pyspark.sql import functions as F

    model = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    assert model.thresholds == sorted(model.thresholds)
    held = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").select("toxic", toxicity.scores(spark, model, F.col("text")).alias("s")).collect()
    clean = [r for r in held if not r["toxic"]]
    assert sum(r["s"]["toxic"] for r in clean) <= 0.03 * len(clean)
    bad = [r for r in held if r["toxic"]]
    assert sum(r["s"]["toxic"] for r in bad) >= 0.5 * len(bad)
    assert all(abs(r["s"]["severity"]) <= 2 and 0 <= r["s"]["p_toxic"] <= 1 for r in held)


def small_problem(rng):
    rows = [(sorted(rng.sample(range(5), rng.randint(0, 3))), None) for _ in range(30)]
    rows = [(c, [rng.uniform(0.5, 2) for _ in c]) for c, _ in rows]
    grades = [min(2, sum(1 for x in c if x < 2) + (rng.random() < 0.2)) for c, _ in rows]
    at = [i for i, (c, _) in enumerate(rows) for _ in c]
    return rows, grades, at, [x for c, _ in rows for x in c], [x for _, v in rows for x in v]


def slow_loss(p, rows, grades, ridge):
    """The ordinal log loss, document by document, from its definition."""
    from math import exp, log

    w, theta = p[:5], [p[5], p[5] + exp(p[6])]
    above = lambda eta, k: 1.0 if k < 0 else 0.0 if k > 1 else 1 / (1 + exp(theta[k] - eta))
    total = 0.0
    for (cols, vals), y in zip(rows, grades):
        eta = sum(w[c] * v for c, v in zip(cols, vals))
        total -= log(max(above(eta, y - 1) - above(eta, y), 1e-9))
    return total / len(rows) + ridge / 2 * sum(x * x for x in w)


def test_ordinal_loss_gradient_and_fit():
    import random

    import numpy as np

    rng = random.Random(6)
    for _ in range(5):
        rows, grades, at, col, val = small_problem(rng)
        args = (np.array(grades), np.array(at), np.array(col), np.array(val), 5)
        p = np.array([rng.uniform(-1, 1) for _ in range(7)])
        value, gradient = toxicity.loss(p, *args)
        assert abs(value - slow_loss(p, rows, grades, toxicity.RIDGE)) < 1e-9
        for i in range(7):
            step = np.eye(7)[i] * 1e-5
            slope = (slow_loss(p + step, rows, grades, toxicity.RIDGE) - slow_loss(p - step, rows, grades, toxicity.RIDGE)) / 2e-5
            assert abs(slope - gradient[i]) < 1e-5
        weights, theta = toxicity.fit_rows(rows, grades, 5, steps=3000)
        found = np.array([*weights, theta[0], np.log(theta[1] - theta[0])])
        q = p.copy()  # a plain descent with halved steps, as slow as it takes
        rate = 1.0
        for _ in range(20000):
            v, g = toxicity.loss(q, *args)
            while toxicity.loss(q - rate * g, *args)[0] > v - rate / 2 * (g @ g) and rate > 1e-12:
                rate /= 2
            q, rate = q - rate * g, min(rate * 2, 50.0)
            if np.abs(g).max() < 1e-6:
                break
        assert toxicity.loss(found, *args)[0] < toxicity.loss(q, *args)[0] + 1e-3


def test_op3_scores_are_the_formula(spark, sf):
    """The registered query against its model's formula, text by text."""
    from math import exp, log1p

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = rows(toxicity.op3_toxicity(spark, sf))
    assert len(got) == docs.count()
    for r in docs.collect():
        words = [w for w in re.split(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+", r["text"].encode().lower()) if w]
        eta = sum(v * log1p((words + [w[:6] + b"*" for w in words if len(w) > 6]).count(k)) for k, v in model.weights.items())
        above = [1 / (1 + exp(t - eta)) for t in model.thresholds]
        s = got[r["doc_id"]]
        assert abs(s["severity"] - sum(above)) < 1e-9 and abs(s["p_toxic"] - above[0]) < 1e-9
        assert s["grade"] == sum(x >= 0.5 for x in above) and s["toxic"] == (s["grade"] > 0)


def test_telling_words(spark):
    import random
    from math import sqrt

    rng = random.Random(8)
    held = [(1, {w for w in range(30) if rng.random() < (0.5 if w < 3 else 0.1)}) for _ in range(60)] + [(0, {w for w in range(30) if rng.random() < 0.1}) for _ in range(200)]
    df = spark.createDataFrame([(b"%d" % w, t) for t, ws in held for w in ws], "word binary, label int")
    got = {bytes(r["word"]) for r in toxicity.telling(df, 60, 200).collect()}
    want = set()
    for w in range(30):
        d1, d0 = (sum(w in ws for t, ws in held if t == x) for x in (1, 0))
        share = (d1 + d0) / 260
        if d1 + d0 >= toxicity.MIN_DOCS and abs(d1 / 60 - d0 / 200) >= toxicity.MIN_Z * sqrt(max(share * (1 - share), 1e-9) * (1 / 60 + 1 / 200)):
            want.add(b"%d" % w)
    assert got == want and want


def test_toxicity_empty_and_repeated(spark):
    from pyspark.sql import functions as F

    empty = spark.createDataFrame([], DOC)
    labels = spark.createDataFrame([(i, int(i % 4 == 1)) for i in range(40)], "doc_id long, toxic int")
    assert toxicity.fit(empty, labels) == toxicity.NOTHING
    assert empty.select(toxicity.scores(spark, toxicity.NOTHING, F.col("text")).alias("s")).count() == 0
    given = [(i, "vile words here" if i % 4 == 1 else "kind words there", None, None, 1) for i in range(40)]
    once, twice = (toxicity.fit(spark.createDataFrame(g, DOC), labels) for g in (given, given + given + [(None, "vile", None, None, 1)] * 3))
    assert once == twice and once.weights
    found = spark.createDataFrame([(None, "vile vile"), (1, None), (1, "kind")], "doc_id long, text string").select("text", toxicity.scores(spark, once, F.col("text")).alias("s"))
    assert {r["text"]: r["s"]["toxic"] for r in found.collect()} == {"vile vile": True, None: False, "kind": False}


def test_toxicity_without_labels_or_texts(spark):
    from pyspark.sql import functions as F

    df = frame(spark)
    model = toxicity.fit(df, spark.createDataFrame([(1, None), (9999, 1)], "doc_id long, toxic int"))
    assert not any(r["s"]["toxic"] for r in df.select(toxicity.scores(spark, model, F.col("text")).alias("s")).collect())


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOC)
    assert simhash.simhash_groups(empty).count() == 0
    assert substring_dedup.remove_duplicates(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert quality.quality_verdicts(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert bpe.encode(empty, *bpe.default_ranks()).count() == 0


def test_digests_of_contract(spark, sf):
    import tiktoken

    from vitrine.llm import registry

    path, pattern = bpe.default_ranks()
    want = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.tokenizer(path, pattern).ranks, special_tokens={})
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in registry.queries()["op7_bpe"](spark, sf).collect():
        ids = want.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_op9_query(spark, sf):
    from vitrine.llm import registry

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sizes = defaultdict(int)
    for r in docs.values():
        sizes[r["source"]] += len(WORDS.findall(r["text"] or ""))
    want, taken = slow_targets(sizes), Counter()
    got = registry.queries()["op9_mixing"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        source = docs[r["doc_id"]]["source"]
        assert (r["size"], r["source_size"]) == (len(WORDS.findall(docs[r["doc_id"]]["text"] or "")), sizes[source])
        assert abs(r["target"] - want[source]) < 1e-6 * max(1, r["target"]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def repeated():
    """Rows that repeat a doc_id with the same and with other texts, and rows without one."""
    word = lambda i, n: " ".join(f"r{i}w{k}" for k in range(n))
    shared = word("s", 60)
    texts = [word(1, 80), word(1, 80), word(2, 50) + " " + shared, shared + " " + word(3, 40), word(4, 90), word(4, 90), shared, word(5, 3)]
    ids = [7, 7, 7, 3, None, None, None, 9]
    return [(d, t, "en", "a", len(t)) for d, t in zip(ids, texts)]


@pytest.mark.parametrize("keep_first", [False, True])
def test_repeated_and_null_ids_suffix(spark, keep_first):
    """Every row is a document of its own; those without doc_id come last."""
    given = repeated()
    order = sorted(range(len(given)), key=lambda i: (given[i][0] is None, given[i][0] or 0))
    data = [given[i][1].encode() for i in order]
    count = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    seen, want = set(), Counter()
    for i, b in zip(order, data):
        gone = bytearray(len(b))
        for j in range(len(b) - 199):
            if (b[j : j + 200] in seen) if keep_first else count[b[j : j + 200]] > 1:
                gone[j : j + 200] = b"\1" * 200
        seen |= {b[j : j + 200] for j in range(len(b) - 199)}
        want[given[i][0], bytes(x for x, g in zip(b, gone) if not g)] += 1
    got = suffix_dedup.remove_repeats(spark.createDataFrame(given, DOC), keep_first=keep_first).collect()
    if keep_first:  # which of rows with equal doc_ids is the first isn't told, so only what stays in all
        assert sum(map(len, (bytes(r["kept"]) for r in got))) == sum(len(k) * n for (_, k), n in want.items())
    else:
        assert Counter((r["doc_id"], bytes(r["kept"])) for r in got) == want


def test_repeated_and_null_ids_substring(spark):
    """A window goes if a smaller doc_id holds it; rows of one doc_id are no copies of each other, rows without stay."""
    given = repeated()
    least: dict = {}
    for d, t, *_ in given:
        w = t.split()
        for i in range(len(w) - 12 if d is not None else 0):
            least[tuple(w[i : i + 13])] = min(d, least.get(tuple(w[i : i + 13]), d))
    want = Counter()
    for d, t, *_ in given:
        w = t.split()
        gone = slow_removed(w, 13, lambda x: d is not None and least[tuple(x)] < d)
        want[d, " ".join(x for x, g in zip(w, gone) if not g).encode()] += 1
    got = substring_dedup.remove_duplicates(spark.createDataFrame(given, DOC)).collect()
    assert Counter((r["doc_id"], bytes(r["kept"])) for r in got) == want


def test_long_text_suffix(spark):
    """A text of two megabytes with one repeat, and a copy of its end."""
    rng = __import__("random").Random(4)
    long = "".join(rng.choices("abcdefgh", k=2_000_000))
    rows_ = [(1, long + long[500:1000], None, None, 1), (2, "x" * 250 + long[-300:], None, None, 1)]
    got = rows(suffix_dedup.remove_repeats(spark.createDataFrame(rows_, DOC)))
    assert got[1]["removed"] == [2_000_000, 2_000_500] and got[2]["removed"] == [1, 550]  # the x, and the end of the long text


def test_op8_counts_spans(spark, tmp_path):
    table = [(d, t if d != 60 else (t or "")[:4000], lang, s, n) for d, t, lang, s, n in ROWS]
    spark.createDataFrame(table, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    data = {d: (t or "").encode() for d, t, *_ in table}
    count = Counter(b[i : i + 200] for b in data.values() for i in range(len(b) - 199))
    for r in suffix_dedup.op8_suffix_dedup(spark, str(tmp_path)).collect():
        b = data[r["doc_id"]]
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        kept = hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), sum(gone), spans, kept)
