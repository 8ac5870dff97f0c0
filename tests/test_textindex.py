"""The text index against scans."""

import random

from pyspark.sql import functions as F

from vitrine.operators import query, textindex

ROWS = "id long, name string, key string"


def texts():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aAbBcÉé日-_ %") for _ in range(rng.randint(0, 12)))
    return [(i, word() if i % 9 else None, word()) for i in range(400)] + [(400, "", ""), (401, None, None), (402, "ab", "STRASSE İx")]


def test_same_rows_as_a_scan(spark, tmp_path):
    df, path = spark.createDataFrame(texts(), ROWS), str(tmp_path / "index")
    textindex.build(df, ["name", "key"], path)
    held = lambda q: F.ilike("name", F.lit(f"%{q}%")) | F.ilike("key", F.lit(f"%{q}%"))
    rng = random.Random(3)
    some = [t for r in texts() for t in r[1:] if t]
    asked = ["abc", "ab", "", "%", "É日a", "strasse", "İx", "a\\_b", "zzz", "a%bc-", "AB_BA"] + [rng.choice(some)[rng.randint(0, 3) :][: rng.randint(1, 7)] for _ in range(25)]
    ids = lambda d: sorted(r["id"] for r in d.select("id").collect())
    for q in asked:
        try:
            want = ids(df.where(held(q)))
        except Exception:  # a backslash at the end is no pattern
            continue
        assert ids(textindex.narrowed(df, path, q).where(held(q))) == want, q
    several = ["abc", "bca", "caa", "É日"]
    any_of = held(several[0])
    for q in several[1:]:
        any_of = any_of | held(q)
    assert ids(textindex.narrowed_to_any(df, path, several).where(any_of)) == ids(df.where(any_of))
    assert ids(textindex.narrowed_to_any(df, path, several[:3]).where(any_of)) == ids(df.where(held("abc") | held("bca") | held("caa")))


def test_few_components_are_left(spark, tmp_path):
    names = [(i, f"common part {i % 50} of many", f"key{i}") for i in range(2000)]
    df, path = spark.createDataFrame(names, ROWS), str(tmp_path / "index")
    textindex.build(df, ["name", "key"], path)
    found = textindex.narrowed(df, path, "art 17 o")
    assert found.count() == 40
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan.replace("IsNotNull(gram), ", "") or "In(gram" in plan
    assert textindex.rarest(spark, path, textindex.needed(spark, "art 17 o"))[0] in ("t 1", " 17", "17 ", "7 o")
    assert query.matching("x") is not None
