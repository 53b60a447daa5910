"""Streaming forms run over the tables: rows arrive in parts by time, some of them
late and some twice, the query is stopped after each part and started again from
its checkpoint, and the sink must hold what the batch twin gives."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegov.functions.text import fmt_ts
from tablegov.plans import q_conditions, q_metrics  # noqa: F401  the batch twins
from tablegov.plans.registry import ORACLE, query
from tablegov.session import ensure_checkpoint_dir
from tablegov.streaming import streams as S

PARTS = 2
# Rows that come a part late stay within this of the newest ones.
DELAY_DAYS = 17
DELAY = f"{DELAY_DAYS} days"


def replay(v, rows: DataFrame, form, tick: dict | None = None, ts: str = "ts", late: str | None = None) -> DataFrame:
    """The sink of ``form(stream)`` after all ``rows``.  Of the rows with an id in
    ``late`` one in 40 comes with the next part.  ``tick`` is a last row of its own
    whose time lets the watermark pass the others."""
    ensure_checkpoint_dir(v.spark)
    home = f"{v.spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    rows = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    first, last = rows.agg(F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))).first()
    first, last = first or 0, last or 0
    part = F.floor((F.unix_micros(ts) - first) * PARTS / (last - first + 1))
    if late:
        part = F.least(F.lit(PARTS - 1), part + F.when(F.pmod(F.xxhash64(late), F.lit(40)) == 0, 1).otherwise(0))
    for no in range(PARTS + bool(tick)):
        more = rows.where(part == no) if no < PARTS else v.spark.createDataFrame(
            [tuple(tick.get(c) for c in rows.columns)], T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]))
        more.write.mode("append").parquet(f"{home}/in")
        stream = form(v.spark.readStream.schema(rows.schema).parquet(f"{home}/in"))
        with S.rocksdb(v.spark):
            S.append_audit(stream, f"{home}/out", f"{home}/state").awaitTermination()
    return v.spark.read.schema(stream.schema).parquet(f"{home}/out")


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc)


def twin(name: str, of: str):
    """Registers a streaming form whose SQL is that of its batch twin."""
    ORACLE[name] = ORACLE[of]
    return query(name)


@twin("stream_audit", "audit_rows")
def _(v):
    # One row in 20 is sent again.
    log = v.log.unionByName(v.log.where("pmod(xxhash64(id), 20) = 0"))
    return replay(v, log, lambda s: S.stream_audit(s, watermark=DELAY), late="id").select(
        "id", "request_ip", "login_location", "seconds", "request_payload")


@twin("stream_rate_limit", "rate_limit")
def _(v):
    rows = replay(v, v.events.select("event_id", "ts", "user_id"), lambda s: S.stream_rate_limit(
        s, 3, "6 hours", client="user_id", watermark=DELAY), {"ts": at("2100-01-01")}, late="event_id")
    return rows.select("client", fmt_ts(F.col("window_start")).alias("window_start"), "calls")


@query("stream_metrics", """SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, method, path, CAST(code // 100 AS BIGINT) AS status_class,
    count(*) AS requests, CAST(sum(CAST(latency AS DECIMAL(18,6))) AS DOUBLE) AS latency_sum FROM v_log GROUP BY ALL""")
def _(v):
    log = v.log.withColumn("latency", F.col("latency").cast("decimal(18,6)"))
    rows = replay(v, log, lambda s: S.stream_metrics(s, width="1 day", watermark=DELAY), {"ts": at("2100-01-01")}, late="id")
    return rows.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "method", "path", "status_class", "requests",
                       F.col("latency_sum").cast("double").alias("latency_sum"))


@twin("stream_active_sessions", "active_sessions")
def _(v):
    """The tick takes the watermark to the moment that is asked for."""
    now = at("2024-01-20")
    events = v.session_event.where("ts <= TIMESTAMP_NTZ '2024-01-20'").withColumn("session_id", F.col("session_id").cast("string"))
    rows = replay(v, events, lambda s: S.stream_active_sessions(s, 86400, DELAY),
                  {"ts": now + dt.timedelta(days=DELAY_DAYS), "kind": "logout", "event_id": -1, "session_id": "-1"}, late="event_id")
    last = rows.groupBy("session_id").agg(F.max(F.struct("at", "state")).alias("last"))
    return last.where("last.state = 'active'").select(
        F.col("session_id").cast("bigint").alias("session_id"), fmt_ts(F.col("last.at")).alias("login_time"))


@twin("stream_job_runs", "job_runs")
def _(v):
    events = v.job_event.withColumn("periodic", F.lit(False))
    tick = {"ts": at("2100-01-01"), "job_id": -1, "event_id": -1, "kind": "submitted", "periodic": False}
    rows = replay(v, events, lambda s: S.stream_job_runs(s, DELAY, 5 * 86400), tick, late="event_id").where("job_id >= 0")
    # A cancelled run can still be settled, in the same moment too.
    rank = F.when(F.col("status") == "running", 0).when(F.col("status") == "cancelled", 1).otherwise(2).alias("rank")
    last = rows.groupBy("run_id", "job_id", "started").agg(F.max(F.struct("at", rank, "status")).alias("last"))
    ended = F.when(F.col("last.status") != "running", fmt_ts(F.col("last.at")))
    return last.select("run_id", "job_id", F.col("last.status").alias("status"), fmt_ts(F.col("started")).alias("started"),
                       ended.alias("ended"))


@query("stream_pv_uv", """SELECT strftime(time_bucket(INTERVAL 2 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS slot, count(*) AS pv, true AS uv_close
    FROM events GROUP BY 1""")
def _(v):
    """Distinct users are estimated; the key tells whether they are within a tenth of the exact number."""
    events = v.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    rows = replay(v, events, lambda s: S.stream_pv_uv(s, watermark=DELAY), {"ts": at("2100-01-01")}, late="event_id")
    exact = events.groupBy(F.window("ts", "2 hours").alias("w")).agg(F.count_distinct("user_id").alias("exact"))
    joined = rows.join(exact, rows["slot"] == F.col("w.start"), "left")
    return joined.select(fmt_ts(F.col("slot")).alias("slot"), "pv", F.coalesce(
        F.abs(F.col("uv") - F.col("exact")) <= F.greatest(F.lit(1), F.col("exact") / 10), F.lit(False)).alias("uv_close"))


@twin("stream_block", "block_requests")
def _(v):
    log = v.log.withColumnRenamed("peer", "ip")
    black, white = log.filter("latency > 200").select("ip"), log.filter("latency < 1").select("ip")
    paths = log.filter("handler = 'signup'").select("path")
    rows = replay(v, log, lambda s: S.stream_block(s, black, white, paths, demo=True))
    return rows.select("id", "ip", "block_reason")
