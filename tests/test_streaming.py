"""Streams over split files must end where the batch does."""

import random

import pytest
import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F

from tablegov.operators.jobs import active_sessions, job_runs, rate_limit
from tablegov.streaming import streams as S


def split(spark, df, path, parts=4, order="event_id"):
    """One file per slice of the order, so that each becomes a micro-batch."""
    df = df.cache()
    n = df.count()
    step = n // parts + 1
    ids = [r[0] for r in df.select(order).orderBy(order).collect()]
    for i in range(parts):
        chunk = ids[i * step:(i + 1) * step]
        if chunk:
            df.filter(F.col(order).between(chunk[0], chunk[-1])).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, tmp_path, name, mode="append"):
    out = []
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / name)).foreachBatch(
        lambda df, _: out.extend(df.collect())).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return out


@pytest.fixture(scope="module")
def log(spark):
    random.seed(8)
    data = [(i, random.randrange(4), i * 2 + random.randrange(3), random.choice(["GET", "POST", "PUT"]), random.choice([200, 404, 500]),
             random.random()) for i in range(300)]
    return spark.createDataFrame(data, "event_id bigint, user_id bigint, s bigint, method string, code int, latency double").select(
        "*", F.timestamp_seconds("s").alias("ts"), F.concat(F.lit("/p"), F.col("user_id").cast("string")).alias("path"),
        F.col("user_id").alias("client"), F.col("event_id").cast("string").alias("uuid"), F.lit("h").alias("handler"),
        F.lit("").alias("referer"), F.lit("").alias("forwarded"), F.lit("10.0.0.1").alias("peer"), F.lit("0.10s").alias("process_time"),
        F.lit("{}").alias("request_payload"))


def test_rate_limit(spark, log, tmp_path):
    stream = split(spark, log, str(tmp_path / "in"))
    got = run(S.stream_rate_limit(stream, 2, "10 seconds", watermark="5 seconds"), tmp_path, "c")
    want = {(r.client, r.window_start, r.calls) for r in rate_limit(log, 2, "10 seconds").collect()}
    last = max(w[1] for w in want)
    closed = {w for w in want if w[1] < last}
    assert closed <= {(r.client, r.window_start, r.calls) for r in got} <= want and len(closed) > 10


def test_metrics(spark, log, tmp_path):
    stream = split(spark, log, str(tmp_path / "in"))
    got = run(S.stream_metrics(stream, width="1 minute", watermark="10 seconds"), tmp_path, "c", "update")
    final = {}
    for r in got:
        final[(r.w.start, r.method, r.path, r.status_class)] = max(r.requests, final.get((r.w.start, r.method, r.path, r.status_class), 0))
    want = {(r.w.start, r.method, r.path, r.c): r["count"] for r in log.groupBy(
        F.window("ts", "1 minute").alias("w"), "method", "path", F.floor(F.col("code") / 100).alias("c")).count().collect()}
    assert final == want


def test_audit_drops_resent_rows(spark, log, tmp_path):
    twice = log.unionByName(log.filter("method = 'POST'"))
    stream = split(spark, twice, str(tmp_path / "in"))
    query = S.append_audit(S.stream_audit(stream), str(tmp_path / "out"), str(tmp_path / "c"))
    query.awaitTermination(300)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == log.filter("method <> 'GET'").count()
    row = out.first()
    assert (row.request_ip, row.seconds) == ("10.0.0.1", 0.1)


def test_block(spark, log, tmp_path):
    stream = split(spark, log.withColumn("ip", F.col("path")), str(tmp_path / "in"))
    lists = [spark.createDataFrame([(x,)], "v string") for x in ("/p1", "/p2", "/p3")]
    got = run(S.stream_block(stream, *lists, demo=True), tmp_path, "c")
    assert len(got) == 300
    for r in got:
        want = "ip_black_list" if r.ip == "/p1" else (
            "demo_mode" if r.method != "GET" and r.ip not in ("/p2", "/p3") else None)
        assert r.block_reason == want


def test_pv_uv(spark, log, tmp_path):
    stream = split(spark, log, str(tmp_path / "in"))
    got = run(S.stream_pv_uv(stream, width="1 minute", watermark="5 seconds"), tmp_path, "c")
    want = {r.w.start: (r.pv, r.uv) for r in log.groupBy(F.window("ts", "1 minute").alias("w")).agg(
        F.count(F.lit(1)).alias("pv"), F.count_distinct("user_id").alias("uv")).collect()}
    assert got and all(want[r.slot] == (r.pv, r.uv) for r in got)


def test_job_runs(spark, tmp_path):
    random.seed(21)
    kinds = ["submitted"] * 4 + ["executed", "error", "missed", "removed"]
    # Times start after the epoch: the first watermark is the epoch itself, and
    # a row that is not later than the watermark is dropped.
    data = [(i, random.randrange(3), i * 3 + 60, random.choice(kinds), False) for i in range(120)]
    # A last event far ahead lets the watermark pass all others.
    data.append((120, 99, 10_000, "submitted", False))
    data.append((121, 99, 20_000, "submitted", False))
    df = spark.createDataFrame(data, "event_id bigint, job_id bigint, s bigint, kind string, periodic boolean").withColumn(
        "ts", F.timestamp_seconds("s"))
    stream = split(spark, df, str(tmp_path / "in"))
    got = run(S.stream_job_runs(stream, "10 seconds"), tmp_path, "c")
    state = {}
    for r in sorted(got, key=lambda r: (r.at, r.status != "running")):
        state[r.run_id] = (r.job_id, r.status)
    want = {r.run_id: (r.job_id, r.status) for r in job_runs(df).filter("job_id <> 99").collect()}
    assert {k: v for k, v in state.items() if v[0] != 99} == want


class MapState:
    """A map state as the stateful handler sees it; counts what is read and written."""

    def __init__(self):
        self.value, self.calls = {}, 0

    def containsKey(self, key):  # noqa: N802
        return key in self.value

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.value[key]

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self.value[key] = value

    def removeKey(self, key):  # noqa: N802
        self.calls += 1
        self.value.pop(key, None)


def test_periodic_job():
    """A settled run of a periodic job opens the next pending one, which the
    next submission starts."""
    entries, ends, changes = MapState(), MapState(), []
    for at, (eid, kind) in enumerate([(1, "executed"), (2, "submitted"), (3, "error"), (4, "removed"), (5, "missed")]):
        runs = S.Runs(entries, ends)
        runs.apply(at, eid, kind, True, changes)
        runs.store()
    assert [(c[0], c[1]) for c in changes] == [
        (1, "success"), (-2, "pending"), (-2, "running"), (-2, "failed"), (-4, "pending"), (-4, "cancelled"),
        (-4, "timeout"), (-6, "pending")]
    assert {k[0]: v[1] for k, v in entries.value.items()} == {"pending": -6} and set(ends.value) == {("pending",)}


def plain_runs(events):
    """The same rule over one list of all runs."""
    runs, changes = [], []

    def latest(*states):
        return max((r for r in runs if r[2] in states), key=lambda r: (r[1], r[0]), default=None)

    def move(run, status):
        runs.remove(run)
        if status in ("running", "cancelled"):
            runs.append((run[0], run[1], status))
        changes.append((run[0], status, run[1]))

    for at, eid, kind, periodic in events:
        if kind == "submitted" and not periodic:
            runs.append((eid, at, "running"))
            changes.append((eid, "running", at))
        elif kind == "submitted":
            if run := latest("pending"):
                move(run, "running")
        elif kind == "removed":
            if run := latest("pending", "running"):
                move(run, "cancelled")
        else:
            status = {"executed": "success", "error": "failed", "missed": "timeout"}[kind]
            if run := latest("running") or latest("cancelled"):
                move(run, status)
            else:
                changes.append((eid, status, at))
            if periodic:
                runs.append((-eid - 1, at, "pending"))
                changes.append((-eid - 1, "pending", at))
    return changes, sorted((s, a, i) for i, a, s in runs)


@pytest.mark.parametrize("seed,periodic", [(1, 0), (2, 1), (3, 0.5), (4, 0.2)])
def test_runs_in_slots_equal_one_list(seed, periodic):
    random.seed(seed)
    weights = [6, 2, 1, 1, 3] if seed != 4 else [9, 1, 1, 1, 8]
    kinds = ["submitted", "executed", "error", "missed", "removed"]
    events = [(i // 2, i, random.choices(kinds, weights)[0], random.random() < periodic) for i in range(1500)]
    entries, ends, changes = MapState(), MapState(), []
    for at in range(0, len(events), 37):
        runs = S.Runs(entries, ends)
        for event in events[at:at + 37]:
            runs.apply(*event, changes)
        runs.store()
    want, left = plain_runs(events)
    assert [c[:3] for c in changes] == want
    assert sorted((k[0], *v) for k, v in entries.value.items()) == left


def test_a_slot_touches_what_it_changes():
    """However many runs are open, a slot reads and writes no more than its events."""
    entries, ends = MapState(), MapState()
    for at in range(0, 20_000, 100):
        runs = S.Runs(entries, ends)
        for i in range(at, at + 100):
            runs.apply(i, i, "submitted", False, [])
        runs.store()
    for kind, step in (("removed", 50), ("executed", 10)):
        entries.calls = 0
        runs = S.Runs(entries, ends)
        for i in range(step):
            runs.apply(30_000 + i, 30_000 + i, kind, False, [])
        runs.store()
        assert entries.calls <= 3 * step + 6
    assert len(entries.value) == 19_990


def test_active_sessions(spark, tmp_path):
    random.seed(5)
    data = [(i, f"s{random.randrange(6)}", i * 5, random.choice(["login", "login", "logout"])) for i in range(80)]
    data += [(80, "tick", 500, "login")]
    df = spark.createDataFrame(data, "event_id bigint, session_id string, s bigint, kind string").withColumn("ts", F.timestamp_seconds("s"))
    stream = split(spark, df, str(tmp_path / "in"))
    got = run(S.stream_active_sessions(stream, 60, "1 second"), tmp_path, "c")
    last = {}
    for r in got:
        # Changes of a session come out in order, expiry after the login it ends.
        last[r.session_id] = r.state
    live = {k for k, state in last.items() if state == "active"}
    want = {r.session_id for r in active_sessions(df, 60, "1970-01-01 00:08:20").collect()}
    assert live == want


class _Value:
    """A state value as the stateful handler sees it."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class _Handle:
    def __init__(self):
        self.state, self.timers = _Value(), set()

    def getValueState(self, *_):  # noqa: N802
        return self.state

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


def test_late_login_does_not_revive_a_session():
    handle, sessions = _Handle(), S._Sessions(60_000)
    sessions.init(handle)

    def send(second, event_id, kind):
        rows = pd.DataFrame({"ts": [pd.Timestamp(second, unit="s")], "event_id": [event_id], "kind": [kind]})
        return [r.state[0] for r in sessions.handleInputRows(("a",), iter([rows]), None)]

    assert send(10, 1, "login") == ["active"] and send(20, 3, "logout") == ["ended"]
    assert send(15, 2, "login") == [] and send(20, 2, "login") == []
    assert handle.timers == {20_001}
    expired = type("T", (), {"getExpiryTimeInMs": lambda self: 20_001})()
    assert list(sessions.handleExpiredTimer(("a",), None, expired)) == [] and not handle.state.exists()
    assert send(30, 4, "login") == ["active"] and handle.timers >= {90_000}


class _JobHandle(_Handle):
    """Map and value states and timers of one job; counts the calls."""

    def __init__(self):
        super().__init__()
        self.maps, self.calls = {}, 0
        for name in ("exists", "get", "update", "clear"):
            setattr(self.state, name, self._counted(getattr(self.state, name)))
        self.registerTimer = self._counted(self.registerTimer)

    def _counted(self, call):
        def counted(*args):
            self.calls += 1
            return call(*args)
        return counted

    def getMapState(self, name, *_):  # noqa: N802
        return self.maps.setdefault(name, MapState())

    def every_call(self):
        return self.calls + sum(m.calls for m in self.maps.values())


def job_slots(events, at_once, slot_ms=1):
    """What the handler of one job gives for (micros, event_id, kind, periodic) events in order."""
    handle, job, out = _JobHandle(), S._JobRuns(slot_ms), []
    job.init(handle)
    for at in range(0, len(events), at_once):
        rows = [Row(us=us, event_id=i, kind=kind, periodic=periodic) for us, i, kind, periodic in events[at:at + at_once]]
        assert list(job.handleInputRows((5,), iter(rows), None)) == []
    for due in sorted(handle.timers):
        expired = type("T", (), {"getExpiryTimeInMs": lambda self, due=due: due})()
        out += [(r.run_id, r.status, r.started) for r in job.handleExpiredTimer((5,), None, expired)]
    return out, handle


@pytest.mark.parametrize("inline,runs,part", [(256, 256, 10_000), (5, 3, 4), (0, 0, 1), (40, 2, 7)])
def test_job_slots_equal_one_list(monkeypatch, inline, runs, part):
    """However many events and runs stand in the one value, the changes are the same."""
    for name, value in (("INLINE_EVENTS", inline), ("INLINE_RUNS", runs), ("PART_EVENTS", part)):
        monkeypatch.setattr(S, name, value)
    random.seed(inline)
    kinds = random.choices(["submitted", "executed", "error", "missed", "removed"], [7, 2, 1, 1, 3], k=400)
    events = [(i // 2 * 100, i, kind, random.random() < 0.3) for i, kind in enumerate(kinds)]
    shuffled = random.sample(events, len(events))
    assert job_slots(shuffled, 60)[0] == plain_runs(events)[0]


def test_a_small_job_reads_and_writes_once_a_slot():
    events = [(i * 1000, i, "submitted", False) for i in range(40)]
    out, handle = job_slots(events, 20)
    assert len(out) == 40 and handle.every_call() <= 2 * 40 + 2 * 2 + 40
    assert not any(m.value for m in handle.maps.values())
