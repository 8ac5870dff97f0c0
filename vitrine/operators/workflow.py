"""Workflow and ingest logs: exactly-once commands, transitions, leases, retries, backlog and counters.

The batch forms are the twins of the streams in vitrine.streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEASE_SECONDS, MAX_ATTEMPTS = 60, 5


def first_commands(log: DataFrame) -> DataFrame:
    """The first event of each command: an aggregate, which is combined before the shuffle."""
    rest = [c for c in log.columns if c not in ("command_id", "ts", "event_id")]
    first = log.groupBy("command_id").agg(F.min_by(F.struct("ts", "event_id", *rest), F.struct("ts", "event_id")).alias("r"))
    return first.select("command_id", "r.*").select(*log.columns)


#: Time that a window of a run's rows covers; a run of any length is dealt to tasks by such ranges.
RANGE_SECONDS = 3600


def with_neighbours(log: DataFrame, columns: list[str], range_seconds: int = RANGE_SECONDS) -> DataFrame:
    """log with structs before and after: columns of the row before and after in the same run, by (ts, event_id).

    Windows hold the rows of one run within one range of time. Each range's first and last row are aggregates, which go on
    to the next range that has rows; so a run with a third of all rows is spread over tasks."""
    place = F.struct("ts", "event_id", *columns)
    rows = log.withColumn("_range", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (range_seconds * 1_000_000)))
    over = Window.partitionBy("run").orderBy("_range")
    ends = rows.groupBy("run", "_range").agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    ends = ends.select("run", "_range", F.lag("_last").over(over).alias("_before"), F.lead("_first").over(over).alias("_after"))
    w = Window.partitionBy("run", "_range").orderBy("ts", "event_id")
    rows = rows.withColumns({"before": F.lag(place).over(w), "after": F.lead(place).over(w)}).join(ends, ["run", "_range"])
    return rows.withColumns({"before": F.coalesce("before", "_before"), "after": F.coalesce("after", "_after")}).drop("_range", "_before", "_after")


def guard_failed() -> Column:
    return F.coalesce(F.startswith("reason", F.lit("guard_failed")), F.lit(False))


def transitions(log: DataFrame, range_seconds: int = RANGE_SECONDS) -> DataFrame:
    """run, event_id, previous, verdict and dwell_s of each row of a transition log (run, event_id, ts, from_state, to_state,
    reason): previous is the state that the rows before have led to. A row is guard_failed by its reason (its to_state is
    the state it stays in), initial where it is the first and names no from_state, ok where from_state is previous, else broken.
    dwell_s is the time since that state was entered; failed guards don't enter one."""
    own, micros = ~guard_failed(), F.unix_micros(F.col("ts").cast("timestamp"))
    rows = with_neighbours(log, ["to_state"], range_seconds)
    rows = rows.withColumn("_t", micros).withColumn("_range", F.floor(F.col("_t") / (range_seconds * 1_000_000))).withColumn("_enters", F.when(own, F.col("_t")))
    w = Window.partitionBy("run", "_range").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("run", "_range").agg(F.max("_enters").alias("_entered"))
    earlier = Window.partitionBy("run").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("run", "_range", F.max("_entered").over(earlier).alias("_entered"))
    rows = rows.withColumn("_own", F.max("_enters").over(w)).join(ends, ["run", "_range"])
    previous = F.col("before.to_state")
    first = F.col("before").isNull() & F.col("from_state").isNull()
    verdict = F.when(~own, "guard_failed").when(first, "initial").when(F.col("from_state") == previous, "ok").otherwise("broken")
    dwell = (F.col("_t") - F.coalesce("_own", "_entered")) / 1e6
    return rows.select("run", "event_id", previous.alias("previous"), verdict.alias("verdict"), F.round(dwell, 3).alias("dwell_s"))


def repeated_steps(log: DataFrame, range_seconds: int = RANGE_SECONDS) -> DataFrame:
    """Each step of a run with the one before, whether it is the same, and the time between them in seconds."""
    rows = with_neighbours(log, ["step"], range_seconds)
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = rows.withColumn("previous", F.col("before.step")).withColumn("dwell_s", F.round((at("ts") - at("before.ts")) / 1e6, 3))
    return rows.withColumn("repeated", F.coalesce(F.col("previous") == F.col("step"), F.lit(False))).drop("before", "after")


def expired_leases(log: DataFrame, lease_seconds: int = LEASE_SECONDS, range_seconds: int = RANGE_SECONDS) -> DataFrame:
    """Steps after which a run shows nothing for longer than the lease; its last step is judged by the log's end."""
    end = log.agg(F.max("ts").alias("_end"))
    df = with_neighbours(log, [], range_seconds).join(end, F.lit(True))  # one row
    gap = F.unix_micros(F.coalesce("after.ts", "_end").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return df.where(gap > lease_seconds * 1_000_000).drop("before", "after", "_end")


def retries(attempts: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Failed attempts with their number and what follows: another try, or the dead-letter list with a reason."""
    failed = attempts.where("status = 'failed'")
    w = Window.partitionBy("run", "step").orderBy("ts", "event_id")
    df = failed.withColumn("attempt", F.row_number().over(w))
    again = (F.col("error_class") == "transient") & (F.col("attempt") < most)
    reason = F.when(again, F.lit(None)).when(F.col("error_class") == "transient", "attempts_exhausted").otherwise(F.col("error_class"))
    return df.withColumn("next", F.when(again, "retry").otherwise("dead_letter")).withColumn("reason", reason)


def backlog(log: DataFrame, window: str = "1 hour") -> DataFrame:
    """Events that weren't dispatched, by window of their creation."""
    df = log.where("status = 'failed'").groupBy(F.window(F.col("ts").cast("timestamp"), window).alias("w")).agg(F.count("*").alias("n_waiting"))
    return df.select(F.col("w.start").cast("string").alias("window_start"), "n_waiting")


def counters(log: DataFrame, window: str = "1 day") -> DataFrame:
    """Steps and failures by tumbling window and step."""
    df = log.groupBy(F.window(F.col("ts").cast("timestamp"), window).alias("w"), "step").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("n_failed"))
    return df.select(F.col("w.start").cast("string").alias("window_start"), "step", "n", "n_failed")


def since_cursor(log: DataFrame, cursors: DataFrame, source: str) -> DataFrame:
    """Rows after their source's cursor (source, cursor; a row for each source); all rows of a source without one."""
    return log.join(cursors.select(source, "cursor"), source, "left").where("cursor is null or ts > cursor").drop("cursor")
