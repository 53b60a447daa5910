"""Job runs out of a job event log, as a batch.

A completion settles the latest running run of its job, which is last-in,
first-out matching.  The state machine is sequential per job, and one job may
own a third of the log, so the matching is done with joins: the running depth
of every event is computed in ranges, and at one depth the k-th start belongs
to the k-th end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegov.operators.ordering import first_of_key, number_in_ranges, range_id, running_depth
from tablegov.session import cut

# Event kind to the status it leaves behind.
OUTCOME = {"executed": "success", "error": "failed", "missed": "timeout", "removed": "cancelled"}


def match_latest(events: DataFrame, key: str, order: list[str], id: str, opens: Column, closes: Column,
                 **ranges) -> tuple[DataFrame, DataFrame]:
    """Pairs each closing row with the latest open row of its key:
    ``(open_id, close_id)``, and the ids of closing rows that found none."""
    step = F.when(opens, 1).when(closes, -1)
    used = events.select(key, *order, *([] if id in order else [id]), step.alias("_step")).filter("_step is not null")
    bucket = range_id(used, order, keys=[key], **ranges)
    used = used if bucket is None else used.withColumn("_range", bucket)
    # Read three times below, and costly to repeat.
    deep = cut(running_depth(used, key, order, "_step"))
    level = F.when(F.col("_step") == 1, F.col("depth")).otherwise(F.col("depth_before"))
    matched = deep.withColumn("_level", level).filter("_level > 0")
    starts = number_in_ranges(matched.filter("_step = 1"), order, "_k", keys=[key, "_level"])
    ends = number_in_ranges(matched.filter("_step = -1"), order, "_k", keys=[key, "_level"])
    pairs = starts.select(key, "_level", "_k", F.col(id).alias("open_id")).join(
        ends.select(key, "_level", "_k", F.col(id).alias("close_id")), [key, "_level", "_k"])
    unmatched = deep.filter("_step = -1 and depth_before = 0").select(F.col(id).alias("close_id"))
    return pairs.select("open_id", "close_id"), unmatched


def job_runs(events: DataFrame, job="job_id", kind="kind", ts="ts", id="event_id", **ranges) -> DataFrame:
    """Runs of one-shot jobs: ``(run_id, job_id, status, started, ended)``.
    Submitting opens a run; executed, error and missed settle the latest
    running one, else the latest cancelled one, else they record a run of their
    own; removing cancels the latest running one."""
    rows = events.select(F.col(job).alias("job_id"), F.col(kind).alias("kind"), F.col(ts).alias("ts"),
                         F.col(id).alias("event_id"))
    ends = list(OUTCOME)
    is_start, is_end = F.col("kind") == "submitted", F.col("kind").isin(ends)
    pairs, loose = match_latest(rows, "job_id", ["ts", "event_id"], "event_id", is_start, is_end, **ranges)
    pairs = cut(pairs)
    removed = rows.filter("kind = 'removed'").select(F.col("event_id").alias("close_id"))
    cancelled = pairs.join(removed, "close_id", "left_semi").select(F.col("open_id").alias("event_id"))
    late = rows.filter(is_end & (F.col("kind") != "removed")).join(
        loose.select(F.col("close_id").alias("event_id")), "event_id", "left_semi")
    # Completions that found nothing running settle the cancelled run that was
    # started last.  They only occur while nothing runs, so a cancelled run can
    # stand at its start time.
    second = rows.join(cancelled, "event_id", "left_semi").withColumn("_role", F.lit("open")).unionByName(
        late.withColumn("_role", F.lit("close")))
    revived, alone = match_latest(second, "job_id", ["ts", "event_id"], "event_id",
                                  F.col("_role") == "open", F.col("_role") == "close", **ranges)
    final = pairs.join(revived.withColumnRenamed("close_id", "final_id"), "open_id", "left").select(
        F.col("open_id").alias("run_id"), F.coalesce("final_id", "close_id").alias("end_id"))
    facts = rows.select(F.col("event_id").alias("end_id"), F.col("ts").alias("ended"), F.col("kind").alias("_end_kind"))
    status = F.lit("running")
    for name, state in OUTCOME.items():
        status = F.when(F.col("_end_kind") == name, state).otherwise(status)
    opened = rows.filter(is_start).select(F.col("event_id").alias("run_id"), "job_id", F.col("ts").alias("started"))
    opened = opened.join(final, "run_id", "left")
    own = rows.join(alone.select(F.col("close_id").alias("event_id")), "event_id", "left_semi").select(
        F.col("event_id").alias("run_id"), "job_id", F.col("ts").alias("started"), F.col("event_id").alias("end_id"))
    return opened.unionByName(own).join(facts, "end_id", "left").select(
        "run_id", "job_id", status.alias("status"), "started", "ended")


def active_sessions(events: DataFrame, ttl_seconds: int, now: str, session="session_id", ts="ts", kind="kind",
                    tiebreak="event_id") -> DataFrame:
    """Sessions whose last event is a login not older than the ttl at ``now``."""
    at = F.lit(now).cast(events.schema[ts].dataType)
    last = first_of_key(events.select(session, ts, tiebreak, kind).filter(F.col(ts) <= at), [session],
                        [(ts, "desc"), (tiebreak, "desc")])
    return last.select(session, F.col(ts).alias("login_time"), F.col(kind).alias("_kind")).filter(
        (F.col("_kind") == "login")
        & (F.col("login_time") + F.expr(f"interval {int(ttl_seconds)} seconds") > at)).drop("_kind")


def rate_limit(log: DataFrame, limit: int = 60, width: str = "10 seconds", slide: str | None = None,
               client="client", ts="ts") -> DataFrame:
    """Windows in which a client made more than ``limit`` calls."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return log.groupBy(F.col(client).alias("client"), window.alias("w")).agg(F.count(F.lit(1)).alias("calls")).filter(
        F.col("calls") > limit).select("client", F.col("w.start").alias("window_start"), "calls")
