"""Streaming forms of the workflow log's operators; vitrine.operators.workflow has their batch twins."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vitrine.operators.workflow import MAX_ATTEMPTS, guard_failed
from vitrine.sources.snapshots import SnapshotTable

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Landed event files as a stream with run, step, status and command_id."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    step = F.col("event_type")
    return rows.select(
        "event_id", F.col("user_id").alias("run"), step.alias("step"), F.col("ts").cast("timestamp").alias("ts"), F.when(step == "error", "failed").otherwise("succeeded").alias("status"),
        F.concat_ws("/", F.col("user_id").cast("string"), step, F.col("ts").cast("date").cast("string")).alias("command_id"),
    )


def first_commands(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """One event for each command: repeats within the watermark's delay are dropped."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["command_id"])


def counters(events: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Steps and failures by tumbling window; late rows beyond the watermark are dropped by Spark."""
    rows = events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "step").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("n_failed"))
    return rows.select(F.col("w.start").cast("string").alias("window_start"), "step", "n", "n_failed")


def backlog(events: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    rows = events.where("status = 'failed'").withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("n_waiting"))
    return rows.select(F.col("w.start").cast("string").alias("window_start"), "n_waiting")


class OrderedProcessor(StatefulProcessor):
    """Holds each key's rows until event time has passed them and then takes them in the order of (at, event_id), so that the
    order in which they arrive within the watermark's delay doesn't matter. Subclasses name the columns of rows and of the
    state that goes from row to row, and take one row at a time."""

    rows: str  # at long, event_id long, and what else take() needs
    state: str

    def take(self, state: tuple | None, row: tuple) -> tuple[tuple, list]:
        """The state after a row, and the rows to give out."""
        raise TypeError("take() is for subclasses")

    def frame(self, key, out: list):
        raise TypeError("frame() is for subclasses")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.rows)
        self.held = handle.getValueState("held", self.state)

    def _passed(self, key, now: int):
        rows = sorted(map(tuple, self.waiting.get()), key=lambda r: r[:2]) if self.waiting.exists() else []
        ready = [r for r in rows if r[0] <= now]
        state, out = (tuple(self.held.get()) if self.held.exists() else None), []
        for row in ready:
            state, more = self.take(state, row)
            out += more
        if ready:
            self.held.update(state)
            self.waiting.put(rows[len(ready) :]) if len(ready) < len(rows) else self.waiting.clear()
        if len(ready) < len(rows):
            self.handle.registerTimer(rows[len(ready)][0])
        return self.frame(key, out)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        names = [c.split()[0] for c in self.rows.split(",")]
        for pdf in rows:
            plain = pdf[names].astype(object).where(pdf[names].notna(), None)
            self.waiting.appendList(list(plain.itertuples(index=False, name=None)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        yield self._passed(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        yield self._passed(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class TransitionProcessor(OrderedProcessor):
    """Checks each transition of an entity against the state that it is in."""

    rows = "at long, event_id long, from_state string, to_state string, guarded boolean"
    state = "state string, entered long"

    def take(self, state, row):
        at, event_id, from_state, to_state, guarded = row
        known, entered = state or (None, None)
        verdict = "guard_failed" if guarded else "initial" if state is None and from_state is None else "ok" if from_state is not None and from_state == known else "broken"
        out = (event_id, known, verdict, None if entered is None else (at - entered) / 1000)
        return (to_state, entered if guarded else at), [out]

    def frame(self, key, out):
        import pandas as pd

        event_id, known, verdict, dwell = zip(*out) if out else ((),) * 4
        columns = {"run": [key[0]] * len(out), "event_id": event_id, "previous": pd.Series(known, dtype=object), "verdict": pd.Series(verdict, dtype=object), "dwell_s": pd.Series(dwell, dtype=float)}
        return pd.DataFrame(columns).astype({"run": "int64", "event_id": "int64"})


def transitions(log: DataFrame, delay: str = "1 minute") -> DataFrame:
    """The batch form's rows (run, event_id, previous, verdict, dwell_s) of a stream of (run, event_id, ts, from_state,
    to_state, reason), as far as event time has passed them (needs the RocksDB state store)."""
    rows = log.withWatermark("ts", delay).withColumn("at", (F.unix_micros("ts") / 1000).cast("long")).withColumn("guarded", guard_failed())
    out = "run long, event_id long, previous string, verdict string, dwell_s double"
    return rows.groupBy("run").transformWithStateInPandas(TransitionProcessor(), out, "append", "eventTime")


class RetryProcessor(OrderedProcessor):
    """Numbers the failed attempts of a step of a run and tells what follows each."""

    rows = "at long, event_id long, error_class string"
    state = "attempts long"

    def __init__(self, most: int):
        self.most = most

    def take(self, state, row):
        n = (state[0] if state else 0) + 1
        transient = row[2] == "transient"
        again = transient and n < self.most
        reason = None if again else "attempts_exhausted" if transient else row[2]
        return (n,), [(row[1], n, "retry" if again else "dead_letter", reason)]

    def frame(self, key, out):
        import pandas as pd

        event_id, n, after, reason = zip(*out) if out else ((),) * 4
        columns = {"event_id": event_id, "attempt": n, "next": pd.Series(after, dtype=object), "reason": pd.Series(reason, dtype=object)}
        return pd.DataFrame(columns).astype({"event_id": "int64", "attempt": "int32"})


def retries(attempts: DataFrame, most: int = MAX_ATTEMPTS, delay: str = "1 minute") -> DataFrame:
    """The batch form's rows (event_id, attempt, next, reason) of a stream of (run, step, event_id, ts, status, error_class).
    Event time goes on with the failed attempts."""
    rows = attempts.where("status = 'failed'").withWatermark("ts", delay).withColumn("at", (F.unix_micros("ts") / 1000).cast("long"))
    return rows.groupBy("run", "step").transformWithStateInPandas(RetryProcessor(most), "event_id long, attempt int, next string, reason string", "append", "eventTime")


class LeaseProcessor(StatefulProcessor):
    """Holds each run's events until event time has passed them and then takes them in the order of time: a lease expires
    where the next event comes after its end, or where event time passes its end without one. The order in which
    events arrive within the watermark's delay doesn't matter."""

    def __init__(self, lease_ms: int):
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, step string")
        self.last = handle.getValueState("last", "at long, step string")

    def _passed(self, run, now: int):
        """Takes what event time has passed, registers the next time to look, and gives the expired leases."""
        import pandas as pd

        gone, last = [], tuple(self.last.get()) if self.last.exists() else None
        events = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        ready = [e for e in events if e[0] <= now]
        for event in ready:
            if last and event[0] - last[0] > self.lease_ms:
                gone.append((last[0] + self.lease_ms, last[1]))
            last = event
        if ready:
            if len(ready) == len(events):
                self.waiting.clear()
            else:
                self.waiting.put(events[len(ready) :])
        if last and last[0] + self.lease_ms < now:  # every event up to now is known, so the next one comes too late
            gone.append((last[0] + self.lease_ms, last[1]))
            last = None
        self.last.update(last) if last else self.last.clear()
        times = [e[0] for e in events[len(ready) : len(ready) + 1]] + ([last[0] + self.lease_ms + 1] if last else [])
        if times:
            self.handle.registerTimer(min(times))
        columns = {"run": [run] * len(gone), "step": [s for _, s in gone], "expired_at": [t for t, _ in gone]}
        return pd.DataFrame(columns).astype({"run": "int64", "step": "object", "expired_at": "int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        for pdf in rows:
            self.waiting.appendList([(int(at), step) for at, step in zip(pdf["at"], pdf["step"])])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        yield self._passed(key[0], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        yield self._passed(key[0], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def expired_leases(events: DataFrame, lease_seconds: int = 60, delay: str = "1 minute") -> DataFrame:
    """Steps after which a run shows nothing for longer than the lease, with the lease's end, as far as event time has passed
    it (needs the RocksDB state store). Events may come out of order by the delay; Spark drops those that are later."""
    rows = events.withWatermark("ts", delay).withColumn("at", (F.unix_micros("ts") / 1000).cast("long"))
    return rows.groupBy("run").transformWithStateInPandas(LeaseProcessor(lease_seconds * 1000), "run long, step string, expired_at long", "append", "eventTime")


def run_to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what has landed and returns its result."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return df.sparkSession.table(name)


def ingest(events: DataFrame, table: SnapshotTable, columns: list[str], sequence: list[str], checkpoint: str, name: str | None = None) -> int | None:
    """Merges what has landed into table, micro-batch by micro-batch, by SnapshotTable.merge: the order of files doesn't
    matter, a batch that is run again after a failure changes nothing, and only the buckets of a batch's keys are rewritten.
    name is the stream's own, its checkpoint by default. Returns the table's newest version."""
    stream = name or checkpoint

    def each(batch: DataFrame, number: int) -> None:
        table.merge(batch, columns, sequence, stream, number)
        table.vacuum()

    query = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return max(table.versions(), default=None)
