"""Streams against their batch twins over the same events."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import plain
from vitrine.operators import workflow as batch
from vitrine.sources.snapshots import SnapshotTable
from vitrine.sources.views import view
from vitrine.streaming import workflow as stream


@pytest.fixture(scope="module")
def landed(spark, sf, tmp_path_factory):
    """The events in three files, in the order of time."""
    path = str(tmp_path_factory.mktemp("events"))
    spark.read.parquet(f"{sf}/events.parquet").repartitionByRange(3, "ts").sortWithinPartitions("ts").write.mode("overwrite").parquet(path)
    return path


def rows(df):
    return sorted([plain(x) for x in r] for r in df.collect())


def test_counters(spark, sf, landed, tmp_path):
    got = stream.run_to_table(stream.counters(stream.read_events(spark, landed)), "counters", str(tmp_path), "complete")
    assert rows(got) == rows(batch.counters(view(spark, sf, "attempt")))


def test_backlog(spark, sf, landed, tmp_path):
    got = stream.run_to_table(stream.backlog(stream.read_events(spark, landed)), "backlog", str(tmp_path), "complete")
    assert rows(got) == rows(batch.backlog(view(spark, sf, "attempt")))


def test_first_commands(spark, sf, landed, tmp_path):
    got = stream.run_to_table(stream.first_commands(stream.read_events(spark, landed, 100), "60 days").select("command_id"), "commands", str(tmp_path))
    assert rows(got) == rows(batch.first_commands(view(spark, sf, "attempt")).select("command_id"))


def newest(spark, sf):
    place = F.struct("ts", "event_id")
    log = view(spark, sf, "attempt").groupBy("run").agg(F.max_by("step", place).alias("step"), F.max_by(F.when(F.col("status") == "failed", F.col("event_id")), F.when(F.col("status") == "failed", place)).alias("failed"))
    return rows(log)


def run_ingest(spark, tmp_path, table, checkpoint="c"):
    events = stream.read_events(spark, str(tmp_path / "events")).withColumn("failed", F.when(F.col("status") == "failed", F.col("event_id")))
    return stream.ingest(events, table, ["step", "failed"], ["ts", "event_id"], str(tmp_path / checkpoint))


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 2, 1, 0), (2, 0, 3, 1)])
def test_incremental_ingest(spark, sf, tmp_path, order):
    """Files in any order give one table, and so does reading them all again from the start."""
    landing(spark, sf, str(tmp_path / "events"), order, 4)
    table = SnapshotTable(spark, str(tmp_path / "table"), "run", 8)
    assert run_ingest(spark, tmp_path, table) == 3
    assert rows(table.values()) == newest(spark, sf)
    assert run_ingest(spark, tmp_path, table) == 3  # nothing new
    run_ingest(spark, tmp_path, table, "again")
    assert rows(table.values()) == newest(spark, sf)
    assert len(table.versions()) == 2 and len(table._names(f"{table.path}/data")) <= 10  # older ones are cleared


@pytest.mark.parametrize("after", [False, True])
def test_ingest_goes_on_after_a_failure(spark, sf, tmp_path, monkeypatch, after):
    """A batch that dies before or after its manifest is published is run again, and counts once."""
    landing(spark, sf, str(tmp_path / "events"), (1, 3, 0, 2), 4)
    table, publish = SnapshotTable(spark, str(tmp_path / "table"), "run", 8), SnapshotTable._publish

    def dies(self, manifest):
        if after:
            publish(self, manifest)
        if manifest["version"] == 2:
            raise OSError("lost")
        return after or publish(self, manifest)

    monkeypatch.setattr(SnapshotTable, "_publish", dies)
    with pytest.raises(Exception, match="lost"):
        run_ingest(spark, tmp_path, table)
    assert table.versions()[-1] == (2 if after else 1)
    monkeypatch.setattr(SnapshotTable, "_publish", publish)
    assert run_ingest(spark, tmp_path, table) == 3
    assert rows(table.values()) == newest(spark, sf)


def landing(spark, sf, path, order, n):
    """The events in n files by time, written one after the other in the given order."""
    import os

    parts = spark.read.parquet(f"{sf}/events.parquet").toPandas().sort_values("ts").reset_index(drop=True)
    os.makedirs(path)
    for k, i in enumerate(order):
        part = parts.iloc[len(parts) * i // n : len(parts) * (i + 1) // n]
        file = f"{path}/part-{k:03d}.parquet"
        part.to_parquet(file, index=False, coerce_timestamps="us")
        os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))  # files are taken by their times


def expected_leases(spark, sf, lease_ms, delay_ms):
    """The leases whose end event time has passed, from the batch form's definition."""
    log = view(spark, sf, "attempt").select("run", "step", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("at")).collect()
    now, runs = max(r["at"] for r in log) - delay_ms, {}
    for r in log:
        runs.setdefault(r["run"], []).append((r["at"], r["step"]))
    return sorted((run, step, at + lease_ms) for run, x in runs.items() for (at, step), after in zip(sorted(x), [*sorted(x)[1:], None]) if at + lease_ms < now and (after is None or after[0] - at > lease_ms))


@pytest.mark.parametrize("order", ["in order", "neighbours swapped", "shuffled by fours"])
def test_expired_leases(spark, sf, tmp_path, order):
    """Exactly the gaps of the log, whatever the order in which its files land within the watermark's delay."""
    n = 12
    files = {"in order": list(range(n)), "neighbours swapped": [i ^ 1 for i in range(n)], "shuffled by fours": [4 * (i // 4) + (2, 0, 3, 1)[i % 4] for i in range(n)]}[order]
    landing(spark, sf, str(tmp_path / "events"), files, n)
    span = spark.read.parquet(f"{sf}/events.parquet").agg((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1000).first()[0]
    delay = {"in order": 60_000, "neighbours swapped": int(span / n * 2.5), "shuffled by fours": int(span / n * 4.5)}[order]
    leases = stream.expired_leases(stream.read_events(spark, str(tmp_path / "events")), 3600, f"{delay} milliseconds")
    got = stream.run_to_table(leases, f"leases_{len(order)}", str(tmp_path / "c"))
    want = expected_leases(spark, sf, 3_600_000, delay)
    assert sorted(map(tuple, got.collect())) == want and want


def test_leases_agree_with_the_batch_form(spark, sf):
    """Gaps between events are the same in both forms."""
    log = view(spark, sf, "attempt")
    at = ((F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long") + 3_600_000).alias("at")
    every = {(r["run"], r["at"]) for r in batch.expired_leases(log, 3600).select("run", at).collect()}
    ends = {(r["run"], r["at"]) for r in log.groupBy("run").agg(F.max("ts").alias("ts")).select("run", at).collect()}
    want = {(run, x) for run, _, x in expected_leases(spark, sf, 3_600_000, 0)}
    assert want <= every and every - ends <= want


def as_transitions(spark, sf, path, order, n):
    """The transition log in n files, written in the given order; returns it as a stream."""
    import os

    log = view(spark, sf, "transition").withColumn("ts", F.col("ts").cast("timestamp")).toPandas().sort_values(["ts", "event_id"]).reset_index(drop=True)
    os.makedirs(path)
    for k, i in enumerate(order):
        file = f"{path}/part-{k:03d}.parquet"
        log.iloc[len(log) * i // n : len(log) * (i + 1) // n].to_parquet(file, index=False, coerce_timestamps="us")
        os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))
    schema = "event_id long, run long, ts timestamp_ntz, status string, from_state string, to_state string, reason string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def passed(df, spark, sf, delay_ms, rows_of="true"):
    """Rows of the batch form that event time, which goes on with rows_of, has passed."""
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    log = view(spark, sf, "attempt").where(rows_of).select("event_id", at.alias("at"))
    return df.join(log.join(log.agg(F.max("at").alias("last")), F.lit(True)).where(f"at <= last - {delay_ms}").select("event_id"), "event_id", "left_semi")


@pytest.mark.parametrize("files", [list(range(8)), [i ^ 1 for i in range(8)], [4 * (i // 4) + (2, 0, 3, 1)[i % 4] for i in range(8)]])
def test_transitions_stream(spark, sf, tmp_path, files):
    """The stream gives the batch form's rows whatever the order of files within the delay."""
    span = spark.read.parquet(f"{sf}/events.parquet").agg((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1000).first()[0]
    delay = 60_000 if files == sorted(files) else int(span / 8 * 4.5)
    log = as_transitions(spark, sf, str(tmp_path / "log"), files, 8)
    got = stream.run_to_table(stream.transitions(log, f"{delay} milliseconds"), f"transitions_{files[0]}", str(tmp_path / "c"))
    want = passed(batch.transitions(view(spark, sf, "transition")), spark, sf, delay)
    number = lambda df: rows(df.select("run", "event_id", "previous", "verdict", F.round("dwell_s", 1).alias("dwell_s")))
    assert len(number(got)) == want.count() > 50
    near = lambda a, b: a[:4] == b[:4] and (a[4] == b[4] or abs(float(a[4]) - float(b[4])) < 0.2)  # milliseconds against microseconds
    assert all(near(a, b) for a, b in zip(number(got), number(want)))


def test_retries_stream(spark, sf, tmp_path):
    landing(spark, sf, str(tmp_path / "events"), (1, 0, 2, 3), 4)
    span = spark.read.parquet(f"{sf}/events.parquet").agg((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1000).first()[0]
    delay = int(span / 4 * 2.5)
    classes = F.element_at(F.array(F.lit("transient"), F.lit("input"), F.lit("policy")), (F.col("event_id") % 3 + 1).cast("int"))
    got = stream.run_to_table(stream.retries(stream.read_events(spark, str(tmp_path / "events")).withColumn("error_class", classes), 3, f"{delay} milliseconds"), "retries", str(tmp_path / "c"))
    log = view(spark, sf, "attempt").withColumn("error_class", classes)
    want = passed(batch.retries(log, 3).select("event_id", "attempt", "next", "reason"), spark, sf, delay, "status = 'failed'")
    assert rows(got) == rows(want) and got.count() > 10


@pytest.mark.parametrize("width", [1, 3600, 10**9])
def test_ranges_of_time_do_not_matter(spark, width):
    """Ties, ranges of one row and of all rows, guards that fail at a range's start, a run with most of the rows."""
    import random

    rng = random.Random(5)
    log, state = [], {}
    for i in range(400):
        run, t = rng.choice([1, 1, 1, 2, 3]), 10 * i // 3 * 700
        guarded, to = rng.random() < 0.3, rng.choice("abc")
        known = state.get(run)
        before = known if rng.random() < 0.8 else rng.choice(["a", None])
        log.append((i, run, t, before, known if guarded else to, "guard_failed:x" if guarded else None))
        state[run] = log[-1][4]
    df = spark.createDataFrame(log, "event_id long, run long, s long, from_state string, to_state string, reason string").withColumn("ts", F.timestamp_seconds("s"))
    want, known, entered, seen = [], {}, {}, set()
    for i, run, t, before, to, reason in log:
        verdict = "guard_failed" if reason else "initial" if run not in seen and before is None else "ok" if before is not None and before == known.get(run) else "broken"
        want.append((run, i, known.get(run), verdict, float(t - entered[run]) if run in entered else None))
        known[run] = to
        seen.add(run)
        if not reason:
            entered[run] = t
    assert sorted(map(tuple, batch.transitions(df, width).collect()), key=lambda r: r[1]) == want
