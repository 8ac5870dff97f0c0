"""Workflow log queries: the batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import workflow as w
from vitrine.operators.registry import upsert
from vitrine.plans.catalogue import Catalogue
from vitrine.sources.folders import new_folder
from vitrine.sources.snapshots import SnapshotTable
from vitrine.sources.views import view

CATALOGUE = Catalogue()
add = CATALOGUE.add


@add("str1_commands", "SELECT command_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY command_id ORDER BY ts, event_id) AS n FROM {attempt}) WHERE n = 1")
def str1_commands(spark, d):
    return w.first_commands(view(spark, d, "attempt")).select("command_id", "event_id")


@add("str2_transitions", "SELECT event_id, previous, coalesce(previous = step, FALSE) AS repeated, round((epoch_us(ts) - epoch_us(t)) / 1e6, 3) AS dwell_s FROM (SELECT *, lag(step) OVER p AS previous, lag(ts) OVER p AS t FROM {attempt} WINDOW p AS (PARTITION BY run ORDER BY ts, event_id))")
def str2_transitions(spark, d):
    return w.repeated_steps(view(spark, d, "attempt")).select("event_id", "previous", "repeated", "dwell_s")


@add("str2_checked", """
WITH t AS (SELECT *, lag(to_state) OVER p AS previous, row_number() OVER p AS n, max(CASE WHEN status = 'succeeded' THEN ts END) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS entered
  FROM {transition} WINDOW p AS (PARTITION BY run ORDER BY ts, event_id))
SELECT run, event_id, previous, CASE WHEN status = 'failed' THEN 'guard_failed' WHEN n = 1 AND from_state IS NULL THEN 'initial' WHEN from_state = previous THEN 'ok' ELSE 'broken' END AS verdict,
  round((epoch_us(ts) - epoch_us(entered)) / 1e6, 3) AS dwell_s FROM t""")
def str2_checked(spark, d):
    """Every transition checked against the state that the ones before have led to."""
    return w.transitions(view(spark, d, "transition"))


@add("str3_leases", "SELECT event_id FROM (SELECT event_id, ts, lead(ts) OVER (PARTITION BY run ORDER BY ts, event_id) AS nxt, max(ts) OVER () AS last FROM {attempt}) WHERE epoch_us(coalesce(nxt, last)) - epoch_us(ts) > 3600000000")
def str3_leases(spark, d):
    return w.expired_leases(view(spark, d, "attempt"), 3600).select("event_id")


@add("str4_retries", """WITH f AS (SELECT *, row_number() OVER (PARTITION BY run, step ORDER BY ts, event_id) AS attempt_no FROM {attempt} WHERE status = 'failed')
SELECT event_id, CAST(attempt_no AS INT) AS attempt, CASE WHEN error_class = 'transient' AND attempt_no < 5 THEN 'retry' ELSE 'dead_letter' END AS next,
  CASE WHEN error_class <> 'transient' THEN error_class WHEN attempt_no >= 5 THEN 'attempts_exhausted' END AS reason FROM f""")
def str4_retries(spark, d):
    return w.retries(view(spark, d, "attempt")).select("event_id", "attempt", "next", "reason")


@add("str5_backlog", "SELECT CAST(date_trunc('hour', ts) AS STRING) AS window_start, count(*) AS n_waiting FROM {attempt} WHERE status = 'failed' GROUP BY 1")
def str5_backlog(spark, d):
    return w.backlog(view(spark, d, "attempt"))


@add("str6_since_cursor", """
WITH c AS (SELECT step, max(ts) - INTERVAL 10 DAY AS cursor FROM {attempt} GROUP BY step),
old AS (SELECT run, max(event_id) AS last_event FROM {attempt} JOIN c USING (step) WHERE ts <= cursor GROUP BY run),
batch AS (SELECT run, max(event_id) AS last_event FROM {attempt} JOIN c USING (step) WHERE ts > cursor GROUP BY run)
SELECT run, coalesce(b.last_event, a.last_event) AS last_event, CASE WHEN b.run IS NULL THEN 'kept' WHEN a.run IS NULL THEN 'new' WHEN a.last_event = b.last_event THEN 'unchanged' ELSE 'updated' END AS outcome
FROM old AS a FULL JOIN batch AS b USING (run)""")
def str6_since_cursor(spark, d):
    """What came after each source's cursor, merged into the table of what was known before."""
    log = view(spark, d, "attempt")
    cursors = log.groupBy("step").agg((F.max("ts") - F.expr("interval 10 days")).alias("cursor"))
    told = w.since_cursor(log, cursors, "step")
    last = lambda rows: rows.groupBy("run").agg(F.max("event_id").alias("last_event"))
    return upsert(last(log.join(cursors, "step").where("ts <= cursor")), last(told), "run", ["last_event"])


@add("str6_ingest", "SELECT run, arg_max(step, struct_pack(t := ts, e := event_id)) AS step, arg_max(k, struct_pack(t := ts, e := event_id)) FILTER (status = 'failed') AS failed_k, max(event_id) AS event_id FROM {attempt} GROUP BY run")
def str6_ingest(spark, d):
    """Batches of the log merged newest first, with one of them twice: each run's newest step and newest failure."""
    log = view(spark, d, "attempt").withColumn("failed_k", F.when(F.col("status") == "failed", F.col("k"))).withColumn("id", F.col("event_id"))
    table = SnapshotTable(spark, new_folder(spark, "runs"), "run")
    for number, on in enumerate(("event_id % 3 = 2", "event_id % 3 = 0", "event_id % 3 = 2", "event_id % 3 = 1")):
        table.merge(log.where(on), ["step", "failed_k"], ["ts", "event_id"], "log", number)
    last = SnapshotTable(spark, new_folder(spark, "last"), "run")
    last.merge(log, ["id"], ["event_id"])
    return table.values().join(last.values().withColumnRenamed("id", "event_id"), "run")


@add("str7_counters", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP)::STRING AS window_start, step, count(*) AS n, count(*) FILTER (status = 'failed') AS n_failed FROM {attempt} GROUP BY 1, 2")
def str7_counters(spark, d):
    return w.counters(view(spark, d, "attempt"))
