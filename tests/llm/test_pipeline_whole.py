"""The whole pipeline against a plain twin: every stage by formula or brute force, from documents to token digests.

The twin takes only the fitted weights from the library; which texts are toxic, near, repeated, drawn and how they are encoded
is worked out here. Draws are random, so the twin holds what is certain of them: targets, copies, and the cut text of each."""

import hashlib
import random
from collections import Counter, defaultdict
from math import log1p

import corpus_pipeline as p
from tests.llm.cases import DOC
from tests.llm.test_documents import slow_targets
from tests.llm.test_near import heads, pairs
from vitrine.llm import bpe, mixing, toxicity

LABEL = "doc_id long, quality int, toxic int"


def corpus():
    """Clean documents of three sources, toxic ones, near and exact copies, and a passage that many share."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 7))) for _ in range(400)]
    slurs = [f"vile{c}" for c in "klmnop"]
    passage, base = rng.choices(words, k=60), rng.choices(words, k=150)
    rows, labels = [], []
    for i in range(150):
        toxic = i % 5 == 0
        text = rng.choices(words, k=rng.randint(30, 90))
        if i % 7 == 1:
            text = list(base)
            text[rng.randrange(len(text))] = f"changed{i % 3}"  # copies, near and exact
        elif i % 7 == 2:
            text = text[:20] + passage + text[20:]
        if toxic:
            for at in rng.sample(range(len(text)), 9):
                text[at] = rng.choice(slurs)
        rows.append((i, " ".join(text), "en", ["hot", "hot", "b", "c"][i % 4], None))
        labels.append((i, 1 - toxic, int(toxic)))
    rows += [(150, None, None, None, None), (151, "", None, "b", 0)]
    return [(d, t, g, s, None if t is None else len(t)) for d, t, g, s, _ in rows], labels


def clean(rows, model):
    """Without the documents whose score passes the least threshold."""

    def eta(text):
        found = [w for w in (text or "").lower().split()]
        said = Counter(w.encode() for w in found) + Counter(w[:6].encode() + b"*" for w in found if len(w) > 6)
        return sum(v * log1p(said[k]) for k, v in model.weights.items())

    return [r for r in rows if eta(r[1]) < min(model.thresholds)]


def without_repeats(rows, width=200):
    """Later copies of byte strings gone, the first kept; copies are judged on the rows as they come in."""
    seen, out = set(), []
    for d, t, g, s, _ in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if w in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(w)
        kept = bytes(x for x, y in zip(b, gone) if not y).decode()
        out.append((d, kept, g, s, len(kept)))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_run_is_what_a_plain_twin_gives(spark, tmp_path):
    import tiktoken

    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, LABEL)
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    got = p.run(spark, str(tmp_path)).collect()

    stay = clean(rows, toxicity.fit(docs, marks))
    assert 20 <= len(rows) - len(stay) <= 40  # the toxic ones
    assert {d for d, *_ in stay} >= {d for d, _, toxic in [(a, b, c) for a, b, c in labels] if not toxic}
    of = heads(stay, pairs(stay))
    single = [r for r in stay if of[r[0]] == r[0]]
    assert len(stay) - len(single) > 10
    kept = without_repeats(single)
    assert sum(len(r[1]) for r in kept) < sum(len(r[1] or "") for r in single) - 1000

    sizes = defaultdict(int)
    for _, t, _, s, _ in kept:
        sizes[s] += len(t.split())
    target = slow_targets(sizes)
    text_of = {d: (t, s) for d, t, _, s, _ in kept}
    taken, copies, cuts = Counter(), Counter(), Counter()
    path, pattern = bpe.default_ranks()
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.tokenizer(path, pattern).ranks, special_tokens={})
    for r in got:
        text, source = text_of[r["doc_id"]]
        words = text.split()
        cut = next(n for n in range(len(words), -1, -1) if sha(text if n == len(words) else " ".join(words[:n])) == r["decoded_sha256"])
        drawn = text if cut == len(words) else " ".join(words[:cut])
        ids = plain.encode_ordinary(drawn)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest())
        taken[source] += cut
        copies[r["doc_id"]] += 1
        cuts[source] += cut < len(words)
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes) and max(cuts.values()) <= 1
    for d, (text, s) in text_of.items():
        if text.split():
            least = min(int(target[s] // sizes[s]), mixing.MAX_REPEATS)
            assert least <= copies[d] <= min(least + 1, mixing.MAX_REPEATS)
    again = p.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
