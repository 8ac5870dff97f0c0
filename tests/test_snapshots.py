"""Snapshot tables: merges in any order, commits that stop anywhere, writers that meet, and what is rewritten."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from vitrine.operators import registry
from vitrine.sources import snapshots
from vitrine.sources.snapshots import SnapshotTable

ROWS = "id int, t int, name string, size int"


def table(spark, tmp_path, buckets=8):
    return SnapshotTable(spark, str(tmp_path / "table"), "id", buckets)


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merges_in_any_order(spark, tmp_path):
    batches = [[(1, 1, "a", None), (2, 5, "x", 7), (2, 5, "y", None)], [(1, 2, None, 3), (1, 0, "older", 9)], [(1, 3, "c", None), (3, None, "no time", None)]]
    frames = [spark.createDataFrame(b, ROWS) for b in batches]
    want = [(1, "c", 3), (2, "y", 7), (3, "no time", None)]
    for i, order in enumerate(itertools.permutations(range(3))):
        t = SnapshotTable(spark, str(tmp_path / f"t{i}"), "id", 4)
        for b in (*order, order[0]):
            t.merge(frames[b], ["name", "size"], ["t"])
        assert content(t.values()) == want


def test_a_batch_counts_once_and_buckets_stay(spark, tmp_path):
    t, rows = table(spark, tmp_path), [(i, 0, f"n{i}", i) for i in range(100)]
    assert t.merge(spark.createDataFrame(rows, ROWS), ["name", "size"], ["t"], "s", 0) == 0
    before = t.manifest()
    assert t.merge(spark.createDataFrame([(5, 9, "late", 1)], ROWS), ["name", "size"], ["t"], "s", 0) is None
    assert t.manifest() == before
    assert t.merge(spark.createDataFrame([(5, 9, "new", None), (5, 8, "old", 50)], ROWS), ["name", "size"], ["t"], "s", 1) == 1
    after = t.manifest()
    assert sum(after["buckets"][b] != f for b, f in before["buckets"].items()) == 1  # one of eight is rewritten
    assert dict((r[0], r[1:]) for r in content(t.values()))[5] == ("new", 50)
    assert t.merge(spark.createDataFrame([], ROWS), ["name", "size"], ["t"], "s", 2) is None
    assert content(t.values(0)) == sorted(((i, f"n{i}", i) for i in range(100)), key=str)  # the version before is still there


def test_outcomes(spark):
    states = lambda rows: registry.as_states(spark.createDataFrame(rows, ROWS), "id", ["name", "size"], ["t"])
    old = states([(1, 5, "a", 1), (2, 5, "b", 1), (3, 5, "c", None), (4, 5, "d", 4)])
    new = states([(1, 4, "late", 9), (2, 6, "b", None), (3, 4, None, 8), (4, 6, "z", None), (9, 0, "n", None)])
    want = [(1, "unchanged"), (2, "unchanged"), (3, "updated"), (4, "updated"), (9, "new")]
    assert content(registry.state_outcomes(old, new, "id", ["name", "size"])) == want
    assert content(registry.state_outcomes(None, new, "id", ["name", "size"])) == [(i, "new") for i, _ in want]


def test_children(spark, tmp_path):
    t, children = table(spark, tmp_path), (lambda rows: spark.createDataFrame(rows, "id int, child string"))
    t.replace_children(children([(1, "a"), (1, "b"), (2, "c"), (3, "d")]), children([(1, ""), (2, ""), (3, "")]))
    t.replace_children(children([(1, "e"), (9, "not asked for")]), children([(1, ""), (2, "")]))
    assert content(t.read()) == [(1, "e"), (3, "d")]  # 2 has lost its child
    t.replace_children(children([]), children([(1, ""), (3, "")]))
    assert content(t.read()) == [] and t.read().columns == ["id", "child"]


STEPS = ["_rows", "_names", "_publish", "_at"]


@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("late", [False, True])
def test_a_commit_that_stops_anywhere(spark, tmp_path, monkeypatch, step, late):
    """Readers see the old table or the new one, whichever call of whichever step is the last."""
    t, children = table(spark, tmp_path), (lambda rows: spark.createDataFrame(rows, "id int, child string"))
    parents = children([(i, "") for i in range(30)])
    t.replace_children(children([(i, "old") for i in range(30)]), parents)
    old, new = [(i, "old") for i in range(30)], [(i, "new") for i in range(0, 30, 2)]
    real, seen = getattr(SnapshotTable, step), set()
    for stop in range(1, 40):
        calls = itertools.count(1)

        def dies(self, *args):
            n = next(calls)
            if n == stop and not late:
                raise OSError("stopped")
            out = real(self, *args)
            if n == stop:
                raise OSError("stopped")
            return out

        monkeypatch.setattr(SnapshotTable, step, dies)
        try:
            t.replace_children(children(new), parents)
            done = True
        except OSError:
            done = False
        monkeypatch.setattr(SnapshotTable, step, real)
        now = content(SnapshotTable(spark, t.path, "id").read())
        assert now in (sorted(old, key=str), sorted(new, key=str))
        seen.add(now == sorted(new, key=str))
        if done:
            break
        if now == sorted(new, key=str):  # back, for the next stop
            t.replace_children(children(old), parents)
    assert done and True in seen
    t.vacuum(1)
    assert content(t.read()) == sorted(new, key=str) and len(t._names(f"{t.path}/data")) == 1


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    """The second of two commits on one version starts again, and both are in the table."""
    t = table(spark, tmp_path)
    t.merge(spark.createDataFrame([(1, 1, "a", 1)], ROWS), ["name", "size"], ["t"])
    publish, other = SnapshotTable._publish, []

    def meets(self, manifest):
        if not other:
            other.append(1)
            monkeypatch.setattr(SnapshotTable, "_publish", publish)
            SnapshotTable(spark, t.path, "id").merge(spark.createDataFrame([(1, 2, "b", None), (2, 1, "c", 3)], ROWS), ["name", "size"], ["t"])
            monkeypatch.setattr(SnapshotTable, "_publish", meets)
        return publish(self, manifest)

    monkeypatch.setattr(SnapshotTable, "_publish", meets)
    assert t.merge(spark.createDataFrame([(1, 3, None, 9)], ROWS), ["name", "size"], ["t"]) == 2
    assert content(t.values()) == [(1, "b", 9), (2, "c", 3)]
    t.vacuum()
    assert t.versions() == [1, 2] and content(t.values()) == [(1, "b", 9), (2, "c", 3)]


def test_random_merges_equal_one(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.choice([0, 0, 0, *range(20)]), rng.randrange(50), rng.choice([None, "x", "y"]), rng.choice([None, 1, 2])) for _ in range(400)]
    parts = [rows[i::5] for i in range(5)] + [rows[::3]]
    rng.shuffle(parts)
    t, once = table(spark, tmp_path), SnapshotTable(spark, str(tmp_path / "once"), "id", 3)
    for p in parts:
        t.merge(spark.createDataFrame(p, ROWS), ["name", "size"], ["t"])
    once.merge(spark.createDataFrame(rows, ROWS), ["name", "size"], ["t"])
    assert content(t.values()) == content(once.values())
    assert snapshots.BUCKETS == 64 and F.col("id") is not None
