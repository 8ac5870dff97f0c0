"""Small awkward tables: nulls, empty and long texts, copies, near copies, shared passages, clashing columns."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(["the", "an", "re", "é", "ou", "ing", "日", "st"]) for _ in range(rng.randint(1, 3))) for _ in range(300)]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, base = " ".join(words(60)), words(120)
    rows = []
    for i in range(n):
        kind = i % 10
        if kind == 0:
            text = " ".join(base)
        elif kind == 1:
            near = list(base)
            near[rng.randrange(len(near))] = "x" + rng.choice(vocabulary)
            text = " ".join(near)
        elif kind == 2:
            text = " ".join(words(20)) + "\n" + passage + "\t" + " ".join(words(rng.randint(0, 30)))
        elif kind == 3:
            text = None if i % 20 == 3 else ""
        elif kind == 4:
            text = rng.choice(["a", "  \n\t ", "one two", "ab " * 400, "z" * 900])
        elif kind == 5:
            text = "\n".join(" ".join(words(6)) for _ in range(10)) + "\n" + "same line here\n" * rng.randint(0, 8)
        else:
            text = " ".join(words(rng.randint(1, 200))) + rng.choice(["", " ###", " !!"])
        rows.append((i, text, None, rng.choice(["a", "b", None]) if i % 3 else "hot", None if text is None else len(text)))
    rows.append((n, " ".join(words(20_000)), "en", "hot", 1))
    return rows


def frame(spark, rows=None):
    """The documents with further columns whose names are those that operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, DOC)
    return df.withColumns({c: F.lit("clash") for c in ("key", "fp", "h", "block", "size", "n_words", "kept", "content", "spans", "t", "_words")})
