"""The pipeline's near-duplicate stage against brute-force Jaccard over sets of five words."""

import random
from itertools import combinations

import corpus_pipeline as p
from tests.llm.cases import DOC, documents
from vitrine.llm.near import near_groups


def similar(x, y):
    sets = []
    for t in (x, y):
        w = [x.lower() for x in (t or "").encode().split()]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def pairs(rows):
    return [(a[0], b[0]) for a, b in combinations(rows, 2) if similar(a[1], b[1]) >= 0.8]


def heads(rows, links):
    least = {r[0]: r[0] for r in rows}
    for _ in rows:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return least


def near_copies():
    """Copies of 20 texts with one to eight words changed, chains of changes, and the awkward documents."""
    rng = random.Random(7)
    rows = documents(2, 40)
    words = [f"w{i}" for i in range(900)]
    for _ in range(20):
        base = rng.choices(words, k=200)
        texts = [base]
        for k in range(1, 9):
            new = list(rng.choice([base, texts[-1]]))
            for at in rng.sample(range(len(new)), k):
                new[at] = "new" + rng.choice(words)
            texts.append(new)
        rng.shuffle(texts)
        rows += [(1000 + len(rows) + i, " ".join(t), None, "a", 1) for i, t in enumerate(texts)]
    return rows


def drawn(spark, rows):
    return {r["doc_id"]: r["component_id"] for r in near_groups(spark.createDataFrame(rows, DOC)).collect()}


def test_stage_finds_all_near_copies(spark, sf):
    rows = near_copies()
    links = pairs(rows)
    want = heads(rows, links)
    got = drawn(spark, rows)
    found = sum(got[a] == got[b] for a, b in links)
    assert len(links) > 150 and found == len(links)  # recall 1
    assert got == want
    kept = [r["doc_id"] for r in p.drop_near_duplicates(spark, spark.createDataFrame(rows, DOC), sf).collect()]
    assert sorted(kept) == sorted({*want.values()})


def test_trees_and_groups_of_many_parts(spark, monkeypatch):
    """Trees of a few nodes, sent to many groups of a few, find what one search finds."""
    from vitrine.llm import near

    monkeypatch.setattr(near, "TREE", 2)
    monkeypatch.setattr(near, "PROBES", 3)
    monkeypatch.setattr(near, "ROWS", 1)  # wide buckets that hold several groups
    rows = near_copies()[45:]
    assert drawn(spark, rows) == heads(rows, pairs(rows))


def test_members_that_only_resemble_a_group(spark):
    """Copies at both sides of 0.8 from their original: some join the group through another copy only, some not at all."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base), None, "a", 1)]
    for i in range(1, 70):
        new = list(base if i % 3 else rows[rng.randrange(len(rows))][1].split())
        for at in rng.sample(range(len(new)), rng.choice([1, 2, 3, 4])):
            new[at] = f"x{i}"
        rows.append((i, " ".join(new), None, "a", 1))
    links = pairs(rows)
    want = heads(rows, links)
    direct = {b for a, b in links if a == 0}
    assert any(want[d] == 0 and d not in direct for d in range(1, 70)) and len({*want.values()}) > 3
    assert drawn(spark, rows) == want


def test_rows_that_repeat_or_lack_an_id(spark, sf):
    """Each row is a document: of equal texts the row with the least doc_id stays, those without one come last."""
    words = [" ".join(f"r{i}w{k}" for k in range(30)) for i in range(4)]
    rows = [(5, words[0]), (5, words[0]), (5, words[1]), (2, words[1]), (None, words[1]), (None, words[2]), (None, words[2]), (9, words[3])]
    docs = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], DOC)
    kept = sorted((str(r["doc_id"]), r["text"]) for r in p.drop_near_duplicates(spark, docs, sf).collect())
    assert kept == sorted([("5", words[0]), ("2", words[1]), ("None", words[2]), ("9", words[3])])
    assert p.drop_near_duplicates(spark, docs.limit(0), sf).count() == 0


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["doc_id"]: r["component_id"] for r in near_groups(docs).collect()} == heads(rows, pairs(rows))
