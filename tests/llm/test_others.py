"""Chat formatting, nearest neighbours and WARC against brute force."""

import base64
import hashlib
import random

import pytest

from tests.conftest import same_rows
from vitrine.llm import ann, chat, registry, warc

ODD = ["", "plain", "<|im_end|>", "<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x|>", "<|", "a\nb<|im_start|>user\n", "\\n<|im_end|>\n", "日本", "<\\|"]


def test_rendered_turns_come_back():
    rng = random.Random(2)
    roles = ["user", "assistant", "", "a\nb", "<|im_end|>", "back\\slash", "\\n", "<|im_start|>x\ny"]
    for _ in range(300):
        turns = [(rng.choice(roles), "".join(rng.choice(ODD) for _ in range(rng.randint(0, 3)))) for _ in range(rng.randint(0, 6))]
        segments = chat.render(turns)
        assert chat.parse("".join(segments)) == turns
        assert all(chat.parse(s) == [t] for s, t in zip(segments, turns))
    assert chat.render([("user", "<|other|> <\\ |")]) == ["<|im_start|>user\n<|other|> <\\ |<|im_end|>\n"]  # untouched where nothing conflicts


def test_chat_digests(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(ODD + [None])) for c in (None, 1, 2, 3) for t in range(rng.randint(1, 40))] + [(9, None, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chat(df)).collect()}
    for c in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1]))]
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0


def test_nearest_is_exact(spark):
    rng = random.Random(5)
    vectors = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(300)] + [[1.0] * 16] * 40 + [[1e-9] * 16, [1e6] + [0.0] * 15, [2.0, 2.0], [1.0, 5.0], [3.0, 3.0]]
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    rows = list(enumerate(vectors + bad)) + [(None, [1.0] * 16)]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got: dict = {}
    for r in ann.nearest(df.where("vec_id % 9 = 0"), df, 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    live = dict(enumerate(vectors))
    want = {}
    for q in (q for q in live if q % 9 == 0):
        near = sorted((sum((x - y) ** 2 for x, y in zip(live[q], v)) ** 0.5, i) for i, v in live.items() if i != q and len(v) == len(live[q]))[:10]
        want[q] = [(n + 1, i, s) for n, (s, i) in enumerate(near)]
    assert {q: [x[:2] for x in sorted(v)] for q, v in got.items()} == {q: [x[:2] for x in v] for q, v in want.items() if v}
    assert all(abs(a[2] - b[2]) < 1e-9 * max(1, b[2]) for q in want for a, b in zip(sorted(got.get(q, [])), want[q]))
    assert ann.nearest(df.limit(0), df).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0


def test_nearest_beyond_squares(spark):
    """Components whose squares leave the range of doubles, next to ordinary ones; repeated ids and candidates."""
    import numpy as np

    rng = np.random.default_rng(4)
    vectors = [*(rng.normal(size=(15, 8)) * 1e200), *rng.normal(size=(9, 8)), *(rng.normal(size=(9, 8)) * 1e-200), *(rng.normal(size=(6, 8)) * 1e-160)]
    given = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(3, vectors[3].tolist()), (16, vectors[17].tolist())]
    df = spark.createDataFrame(given, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.nearest(df.where("vec_id % 2 = 0"), df, 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, len(vectors), 2):
        own = min(v for i, v in given if i == q)
        want = sorted((float(ann.distance(np.array([own]), np.array([v]))[0]), i) for i, v in given if i != q)[:10]
        assert sorted(got[q]) == [(n + 1, i, s) for n, (s, i) in enumerate(want)]


def test_nearest_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROW_BYTES", 8 * 4 * 7)
    monkeypatch.setattr(ann, "COLUMN_BYTES", 8 * 4 * 50)
    rng = random.Random(9)
    rows = [(i, [rng.randint(-3, 3) + 0.5 for _ in range(4)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.nearest(df.where("vec_id % 20 = 0"), df, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q in range(0, 400, 20):
        near = sorted((sum((x - y) ** 2 for x, y in zip(rows[q][1], v)), i) for i, v in rows if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i) for n, (_, i) in enumerate(near)]


def test_chat_repeated_turns_and_long_conversation(spark):
    """Rows of one turn stay side by side, in the order of role and text; a conversation is longer than an Arrow batch."""
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "<|im_end|>"), (1, 1, "assistant", "b")] + [(2, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(12_000)]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got[1]["n_turns"] == 4 and got[1]["loss_chars"] == len("<|im_end|>b")
    whole = "".join(f"{r}\n{t}\n" for _, _, r, t in rows[4:])
    assert got[2]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest() and got[2]["n_turns"] == 12_000


def test_warc_null_and_repeated_pages(spark, tmp_path):
    rows = [(None, "http://a/", "same"), (None, "http://b/", "only null"), (4, "http://a/", "same"), (4, "http://a/", "same"), (4, "http://c/", "other"), (2, None, "same")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], str(r["refers_to"])) for r in warc.op10_warc(spark, str(tmp_path)).collect())
    want = [("None", 4, "revisit", "4"), ("None", 9, "response", "None"), ("4", 4, "response", "None"), ("4", 4, "response", "None"), ("4", 5, "response", "None"), ("2", 4, "revisit", "4")]
    assert got == sorted(want)


def test_attempts_write_files_of_their_own(spark, tmp_path):
    pages = warc.with_revisits(spark.createDataFrame([(i, f"http://h{i % 3}/", f"p{i}") for i in range(20)], "page_id long, url string, html string"))
    first, second = (warc.write_archives(pages, f"file://{tmp_path}").select("file").distinct().collect() for _ in range(2))
    assert not {r["file"] for r in first} & {r["file"] for r in second}


@pytest.mark.parametrize("block_lines", [1024, 3])
def test_warc_round_trip(spark, tmp_path, monkeypatch, block_lines):
    monkeypatch.setattr(warc, "BLOCK_LINES", block_lines)
    rng = random.Random(7)
    bodies = ["", None, "<p>é\r\n\r\nWARC/1.1</p>", "same", "x" * 100_000]
    urls = ["http://a.example.com/x?q=1#f", "https://www.b.org", None, "http://user@c.net:8080/ü p", "ftp://a.example.com/x?q=1"]
    rows = [(i, rng.choice(urls), rng.choice(bodies + [f"only {i}"]), "clash") for i in range(80)]
    spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(5).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r for r in warc.op10_warc(spark, str(tmp_path)).collect()}
    last = {}
    for i, _, html, _ in rows:
        last[html or ""] = max(i, last.get(html or "", -1))
    assert len(got) == len(rows)
    for i, _, html, _ in rows:
        data, r = (html or "").encode(), got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if last[html or ""] == i else ("revisit", last[html or ""]))


def test_url_keys():
    assert warc.url_key("http://www.Example.com/a/b?c#d") == "com,example,www)/a/b?c"
    assert warc.url_key(None) == ")/" and warc.url_key("https://x.org:81?q") == "org,x:81)?q"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, sf, duck, name):
    same_rows(registry.queries()[name](spark, sf), duck.sql(registry.oracle_sql()[name]))
