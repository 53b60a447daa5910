"""Structured Streaming forms.  Each takes a ``watermark``: rows later than it
are dropped and counted in the query progress."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tablegov.functions.checks import location_label
from tablegov.functions.text import client_ip, process_seconds, truncate_payload
from tablegov.operators.conditions import audit_filter, block_requests
from tablegov.operators.jobs import OUTCOME, rate_limit
from tablegov.operators.metrics import pv_uv, request_metrics

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def audit_rows(log: DataFrame) -> DataFrame:
    """Recorded requests with address, place, seconds and bounded payload.
    Stateless: the same on a batch and on a stream."""
    ip = client_ip(F.col("forwarded"), F.col("peer"))
    return audit_filter(log).withColumn("request_ip", ip).withColumn(
        "login_location", location_label(F.col("request_ip"))).withColumn(
        "seconds", process_seconds(F.col("process_time"))).withColumn(
        "request_payload", truncate_payload(F.col("request_payload")))


def stream_audit(log: DataFrame, key: str = "uuid", ts: str = "ts", watermark: str = "10 minutes") -> DataFrame:
    """Audit rows with re-sent requests dropped."""
    return audit_rows(log).withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def append_audit(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Append to the log table; the checkpoint makes restarts exactly-once."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_rate_limit(log: DataFrame, limit: int = 60, width: str = "10 seconds", slide: str | None = None,
                      client: str = "client", ts: str = "ts", watermark: str = "1 minute") -> DataFrame:
    return rate_limit(log.withWatermark(ts, watermark), limit, width, slide, client, ts)


def stream_metrics(log: DataFrame, ts: str = "ts", width: str = "1 minute", watermark: str = "10 minutes",
                   latency: str = "latency") -> DataFrame:
    """Request totals and latency per tumbling window."""
    return log.withWatermark(ts, watermark).groupBy(
        F.window(ts, width).alias("w"), "method", "path", F.floor(F.col("code") / 100).alias("status_class")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(latency).alias("latency_sum"),
        F.percentile_approx(latency, 0.99, 10_000).alias("p99"))


def stream_pv_uv(events: DataFrame, ts: str = "ts", user: str = "user_id", width: str = "2 hours",
                 watermark: str = "1 hour") -> DataFrame:
    return pv_uv(events.withWatermark(ts, watermark), ts, user, width, approx=True)


def stream_block(log: DataFrame, black: DataFrame, white: DataFrame, paths: DataFrame, demo: bool) -> DataFrame:
    """Stream-static join with the lists."""
    return block_requests(log, black, white, paths, demo)


# --- stateful -----------------------------------------------------------------

class _Sessions(StatefulProcessor):
    """The last event of each session id.  A login is forgotten when its time to
    live is over; a logout only once the watermark has passed it, so that an
    older login that comes late does not bring the session back."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts bigint, event_id bigint, kind string, timer bigint")

    def _row(self, key, at: int, state: str) -> pd.DataFrame:
        return pd.DataFrame({"session_id": [key[0]], "at": [pd.Timestamp(at, unit="ms")], "state": [state]})

    def _keep(self, at: int, event_id: int, kind: str) -> None:
        if self.last.exists():
            self.handle.deleteTimer(self.last.get()[3])
        timer = at + (self.ttl_ms if kind == "login" else 1)
        self.last.update((at, event_id, kind, timer))
        self.handle.registerTimer(timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # The last event decides; only that one row is kept across batches of rows.
        last = None
        for batch in rows:
            top = batch.sort_values(["ts", "event_id"]).iloc[-1]
            if last is None or (top["ts"], top["event_id"]) > (last["ts"], last["event_id"]):
                last = top
        at, event_id = int(last["ts"].timestamp() * 1000), int(last["event_id"])
        if self.last.exists() and tuple(self.last.get()[:2]) > (at, event_id):
            return
        self._keep(at, event_id, last["kind"])
        yield self._row(key, at, "active" if last["kind"] == "login" else "ended")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ended = self.last.exists() and self.last.get()[2] != "login"
        self.last.clear()
        if not ended:
            yield self._row(key, expiredTimerInfo.getExpiryTimeInMs(), "expired")

    def close(self) -> None:
        pass


def stream_active_sessions(events: DataFrame, ttl_seconds: int, watermark: str = "1 minute") -> DataFrame:
    """``(session_id, at, state)`` changes from ``(session_id, ts, kind,
    event_id)`` events; the newest change per session tells whether it lives."""
    return events.withWatermark("ts", watermark).groupBy("session_id").transformWithStateInPandas(
        _Sessions(ttl_seconds * 1000), "session_id string, at timestamp, state string", "Append", "eventTime")


class _Line:
    """The runs ``(started, run_id)`` of one status, in order, as numbered entries of
    a map state.  Both ends are reached directly; only entries that were touched
    are read and written."""

    def __init__(self, entries, ends, status: str) -> None:
        self.entries, self.ends, self.status = entries, ends, status
        self.low, self.high = ends.getValue((status,)) if ends.containsKey((status,)) else (0, 0)
        self.stored = range(self.low, self.high)
        self.seen: dict[int, tuple] = {}
        self.changed: set[int] = set()

    def _at(self, no: int) -> tuple:
        if no not in self.seen:
            self.seen[no] = tuple(self.entries.getValue((self.status, no)))
        return self.seen[no]

    def _set(self, no: int, run: tuple) -> None:
        self.seen[no] = run
        self.changed.add(no)

    def last(self) -> tuple | None:
        return self._at(self.high - 1) if self.high > self.low else None

    def pop(self) -> tuple:
        run = self.last()
        self.high -= 1
        self.changed.add(self.high)
        return run

    def add(self, run: tuple) -> None:
        """Most runs belong at one of the ends; others move the later ones up."""
        if self.high > self.low and run < self._at(self.low):
            self.low -= 1
            self._set(self.low, run)
            return
        no = self.high
        self.high += 1
        while no > self.low and self._at(no - 1) > run:
            self._set(no, self._at(no - 1))
            no -= 1
        self._set(no, run)

    def store(self) -> None:
        for no in self.changed:
            if self.low <= no < self.high:
                self.entries.updateValue((self.status, no), self.seen[no])
            elif no in self.stored:
                self.entries.removeKey((self.status, no))
        if self.high > self.low:
            self.ends.updateValue((self.status,), (self.low, self.high))
        elif len(self.stored):
            self.ends.removeKey((self.status,))


# Events and runs of a job that are kept in one value; a batch of the rows beyond.
INLINE_EVENTS, INLINE_RUNS, PART_EVENTS = 256, 256, 10_000
# Stands for a time that is null, before all others.
_NO_TIME = -(1 << 63)


class _Held(dict):
    """Entries of a map state as they are kept in one value."""

    containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.pop


class _JobRuns(StatefulProcessor):
    """Events of a job wait in slots of time until the watermark has passed the
    slot's end; each slot has a timer of its own and is applied in order of time.
    The unsettled runs stay in the state store, as a line for each status.  So a
    task holds the events of one slot and the runs that these touch, however many
    events and runs the job has.  What little most jobs have is one value, read
    and written once a slot; only what exceeds it goes to maps."""

    def __init__(self, slot_ms: int) -> None:
        self.slot_ms = slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Waiting events by slot, runs unless (empty text) they are in the maps, and how many slots are in the maps too.
        self.inline = handle.getValueState("inline", "events string, runs string, spilled int")
        # Packed events of a slot, one entry for each batch of rows, and the number of entries.
        self.waiting = handle.getMapState("waiting", "slot bigint, part int", "events string")
        self.parts = handle.getMapState("parts", "slot bigint", "many int")
        self.entries = handle.getMapState("runs", "status string, no bigint", "started bigint, run_id bigint")
        self.ends = handle.getMapState("ends", "status string", "low bigint, high bigint")

    def _load(self) -> tuple[dict, str, int]:
        events, runs, spilled = self.inline.get() or ("{}", "[[], []]", 0)
        return json.loads(events), runs, spilled

    def _spill(self, slot: int, some: list) -> int:
        """1 for a slot that had nothing in the maps."""
        part = self.parts.getValue((slot,))[0] if self.parts.containsKey((slot,)) else 0
        self.waiting.updateValue((slot, part), (json.dumps(some),))
        self.parts.updateValue((slot,), (part + 1,))
        self.handle.registerTimer((slot + 1) * self.slot_ms)
        return int(not part)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        events, runs, spilled = self._load()
        fresh: dict[int, list] = {}
        for no, row in enumerate(rows, 1):
            at = _NO_TIME if row.us is None else row.us
            fresh.setdefault(at // (self.slot_ms * 1000), []).append((at, row.event_id, row.kind, row.periodic))
            if no % PART_EVENTS == 0:
                spilled += sum(self._spill(*s) for s in fresh.items())
                fresh = {}
        free = INLINE_EVENTS - sum(map(len, events.values()))
        for slot, some in fresh.items():
            if len(some) > free:
                spilled += self._spill(slot, some)
                continue
            free -= len(some)
            if str(slot) not in events:
                self.handle.registerTimer((slot + 1) * self.slot_ms)
            events.setdefault(str(slot), []).extend(some)
        self.inline.update((json.dumps(events), runs, spilled))
        yield from ()

    def _due(self, slot: int) -> Iterator[list]:
        for part in range(self.parts.getValue((slot,))[0]):
            yield from json.loads(self.waiting.getValue((slot, part))[0])
            self.waiting.removeKey((slot, part))
        self.parts.removeKey((slot,))

    def _apply(self, kept: str, due: list) -> tuple[str, list[tuple]]:
        """The runs after the events that are due, and the changes."""
        small, changes = bool(kept), []
        states = (self.entries, self.ends)
        if small:
            states = tuple(_Held((tuple(k), tuple(v)) for k, v in part) for part in json.loads(kept))
        runs = Runs(*states)
        for at, event_id, kind, periodic in sorted(due, key=lambda e: (e[0], e[1])):
            runs.apply(at, event_id, kind, periodic, changes)
        runs.store()
        if small and len(states[0]) <= INLINE_RUNS:
            return json.dumps([list(s.items()) for s in states]), changes
        for held, state in zip(states, (self.entries, self.ends)) if small else ():
            for k, v in held.items():
                state.updateValue(k, v)
        return "", changes

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # Nothing before the watermark can still arrive, and timers fire in order of time.
        slot = expiredTimerInfo.getExpiryTimeInMs() // self.slot_ms - 1
        events, kept, spilled = self._load()
        due = events.pop(str(slot), [])
        if spilled and self.parts.containsKey((slot,)):
            due += self._due(slot)
            spilled -= 1
        kept, changes = self._apply(kept, due)
        if events or spilled or kept != "[[], []]":
            self.inline.update((json.dumps(events), kept, spilled))
        else:
            self.inline.clear()
        for run_id, status, started, at in changes:
            yield Row(job_id=key[0], run_id=run_id, status=status, started=_time(started), at=_time(at))

    def close(self) -> None:
        pass


def _time(us: int) -> int | None:
    return None if us == _NO_TIME else us


class Runs:
    """The unsettled runs of one job and what an event does to them."""

    def __init__(self, entries, ends) -> None:
        self.states, self.lines = (entries, ends), {}

    def line(self, status: str) -> _Line:
        if status not in self.lines:
            self.lines[status] = _Line(*self.states, status)
        return self.lines[status]

    def _latest(self, *statuses: str) -> str | None:
        """The status of the run that started last."""
        found = [(run, s) for s in statuses if (run := self.line(s).last()) is not None]
        return max(found)[1] if found else None

    def apply(self, at: int, event_id: int, kind: str, periodic: bool, changes: list[tuple]) -> None:
        """One scheduler event; every new status goes to ``changes`` as ``(run_id,
        status, started, at)``.  A settled run is forgotten."""
        def move(source: str, status: str) -> None:
            started, run_id = run = self.line(source).pop()
            if status in ("running", "cancelled"):
                self.line(status).add(run)
            changes.append((run_id, status, started, at))

        def begin(run_id: int, status: str) -> None:
            self.line(status).add((at, run_id))
            changes.append((run_id, status, at, at))

        if kind == "submitted":
            if not periodic:
                begin(event_id, "running")
            elif self._latest("pending"):
                move("pending", "running")
        elif kind == "removed":
            if source := self._latest("pending", "running"):
                move(source, "cancelled")
        elif kind in OUTCOME:
            if source := self._latest("running") or self._latest("cancelled"):
                move(source, OUTCOME[kind])
            else:
                changes.append((event_id, OUTCOME[kind], at, at))
            if periodic:
                # A run of its own; the settling event may already have used this id.
                begin(-event_id - 1, "pending")

    def store(self) -> None:
        for line in self.lines.values():
            line.store()


def stream_job_runs(events: DataFrame, watermark: str = "10 minutes", slot_seconds: int = 60) -> DataFrame:
    """Status changes ``(job_id, run_id, status, started, at)`` from ``(job_id,
    ts, event_id, kind, periodic)``.  The newest change of a run is its state.
    Longer slots need fewer timers and hold more events of a job at once."""
    rows = events.withWatermark("ts", watermark).withColumn("us", F.unix_micros("ts")).groupBy("job_id").transformWithState(
        _JobRuns(slot_seconds * 1000), "job_id bigint, run_id bigint, status string, started bigint, at bigint",
        "Append", "eventTime")
    return rows.select("job_id", "run_id", "status", F.timestamp_micros("started").alias("started"),
                       F.timestamp_micros("at").alias("at"))


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which map and timer states need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


__all__ = [
    "ROCKSDB", "Runs", "append_audit", "audit_rows", "request_metrics", "rocksdb", "stream_active_sessions",
    "stream_audit", "stream_block", "stream_job_runs", "stream_metrics", "stream_pv_uv", "stream_rate_limit",
]
