"""Hashes of groups are streamed: right values for nulls and large groups, and no array of a group's lines."""

import hashlib

from vitrine.operators.judgment import conversation_prompts
from vitrine.operators.registry import content_hashes


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_content_hashes(spark):
    files = [("hot", f"p{i * 7919 % 30000}", "h") for i in range(30000)] + [("é", "b", "2"), ("é", "a", "1"), ("é", "a", None), (None, "x", "y"), ("none", None, "z")]
    df = content_hashes(spark.createDataFrame(files, "revision string, path string, content_hash string"))
    want = {}
    for rev in {f[0] for f in files}:
        lines = sorted(f"{p}\t{h}\n".encode() for r, p, h in files if r == rev and p is not None and h is not None)
        want[rev] = (sum(f[0] == rev for f in files), hashlib.sha256(b"".join(lines)).hexdigest())
    assert {r["revision"]: (r["n_files"], r["content_hash"]) for r in df.collect()} == want
    assert "collect_list" not in plan(df)


def test_conversation_prompts(spark):
    turns = [(1, i, "user", f"t{i} é") for i in reversed(range(12000))] + [(2, 0, "a", None), (2, 1, None, "b"), (None, 0, "a", "b"), ((1 << 60) + 1, 0, "a", "c")]
    df = conversation_prompts(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"))
    want = {}
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: t[1])
        text = "\n".join(": ".join(x for x in t[2:] if x is not None) for t in own)
        want[conv] = (len(own), hashlib.sha256(text.encode()).hexdigest())
    assert {r["conv_id"]: (r["n_turns"], r["prompt_hash"]) for r in df.collect()} == want
    assert "collect_list" not in plan(df)
