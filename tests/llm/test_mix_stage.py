"""The pipeline's mixing stage with null and repeated doc_ids: its rows and the words of each source."""

import random
from collections import Counter

import corpus_pipeline as p
from tests.llm.cases import DOC
from vitrine.llm import mixing


def test_rows_and_words(spark, sf):
    rng, rows = random.Random(5), []
    for i in range(120):
        doc_id = None if i % 6 == 0 else 7 if i % 6 == 1 else i
        text = " ".join(f"r{i}w{k}" for k in range(rng.randint(2, 40)))  # each row's words are its own
        rows.append((doc_id, text, None, ["a", "b", None][i % 3 if i % 2 else i % 2], len(text)))
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    out = [tuple(r) for r in p.mix_sources(spark, docs, sf).collect()]

    target = {r["source"]: r["target"] for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    size, words = Counter(), Counter()
    for r in rows:
        size[r[3]] += len(r[1].split())
    for r in out:
        words[r[3]] += len(r[1].split())
    assert {s: abs(words[s] - target[s]) <= 1 for s in size} == dict.fromkeys(size, True)

    given, got = {r[1].split("w")[0]: r for r in rows}, Counter()
    cut = Counter()
    for doc_id, text, lang, source, n_chars in out:
        of = given[text.split("w")[0]]
        assert (doc_id, lang, source, n_chars) == (of[0], of[2], of[3], len(text))
        if text != of[1]:
            assert of[1].startswith(text + " ")
            cut[source] += 1
        got[of[1]] += 1
    for r in rows:
        copies = min(int(target[r[3]] // size[r[3]]), mixing.MAX_REPEATS)
        assert copies <= got[r[1]] <= min(copies + 1, mixing.MAX_REPEATS)
    assert max(cut.values(), default=0) <= 1
    # the exact multiset that the draws of the same rows, told apart by their text, ask for
    want = Counter()
    for r in mixing.mix(docs.withColumnRenamed("lang", "was").withColumn("tag", docs["text"]), carry=("tag",)).collect():
        for d in r["draws"]:
            want[" ".join(r["tag"].split()[: d["words"]])] += 1
    assert sum(want.values()) == len(out)
    whole = {t: n for t, n in want.items() if t in {r[1] for r in rows}}
    same = Counter(t for _, t, *_ in out if t in {r[1] for r in rows})
    assert sum((Counter(whole) - same).values()) <= 2 * len(size)  # only rows of one doc_id and size may change places
