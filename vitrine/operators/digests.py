"""SHA-256 over the lines of a group in order, whose memory doesn't grow with the group."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sha256_of_lines(rows: DataFrame, key: str, count: str, digest: str, between: bytes) -> DataFrame:
    """key, the number of its rows and the SHA-256 of their lines (binary, nulls left out) in the order of place."""

    def digested(batches):
        import pandas as pd

        state = None  # key, rows, hash, whether a line went in
        for pdf in batches:
            out = []
            for k, line in zip(pdf[key], pdf["line"]):
                if state is None or state[0] != k:
                    if state:
                        out.append((state[0], state[1], state[2].hexdigest()))
                    state = [k, 0, hashlib.sha256(), False]
                state[1] += 1
                if line is not None:
                    if state[3]:
                        state[2].update(between)
                    state[2].update(line)
                    state[3] = True
            if out:
                yield pd.DataFrame(out, columns=[key, count, digest])
        if state:
            yield pd.DataFrame([(state[0], state[1], state[2].hexdigest())], columns=[key, count, digest])

    placed = rows.repartition(key).sortWithinPartitions(key, "place").select(F.col(key).cast("string").alias(key), "line")  # pandas has no null integers
    found = placed.mapInPandas(digested, f"{key} string, {count} long, {digest} string")
    return found.select(F.col(key).cast(rows.schema[key].dataType).alias(key), count, digest)
