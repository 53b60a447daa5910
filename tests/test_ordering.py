"""Range-split positions and running values against plain Python, with one key
holding a third of all rows and many equal sort values."""

import random

import pytest
from pyspark.sql import functions as F

from tablegov.operators import jobs as J
from tablegov.operators import metrics as M
from tablegov.operators import page as P
from tablegov.operators.metrics import exact_percentile
from tablegov.operators.ordering import first_of_key, number_rows, range_id, running_depth, sort_columns
from tablegov.streaming.streams import Runs
from tests.test_streaming import MapState

random.seed(5)
DATA = [(i, "hot" if random.random() < 0.34 else f"k{random.randrange(20)}",
         random.choice([1.5, 1.5, 2.0, None, random.random()]), random.choice(["x", None, "y", f"s{i % 7}"])) for i in range(600)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(DATA, "id bigint, key string, v double, s string").repartition(5)


def python_order(order):
    """Rows sorted like Spark: nulls first ascending, last descending."""
    out = list(DATA)
    at = {"id": 0, "key": 1, "v": 2, "s": 3}
    for col, direction in reversed(order):
        i = at[col]
        out.sort(key=lambda r: (r[i] is not None, r[i] if r[i] is not None else 0 if i in (0, 2) else ""),
                 reverse=direction == "desc")
    return out


ORDERS = [
    [("id", "asc")], [("id", "desc")], [("v", "asc"), ("id", "asc")], [("v", "desc"), ("id", "desc")],
    [("s", "desc"), ("id", "asc")], [("s", "asc"), ("v", "desc"), ("id", "desc")], [("v", "desc"), ("id", "asc")],
]


@pytest.mark.parametrize("order", ORDERS)
def test_number_rows(df, order):
    want = {r[0]: n for n, r in enumerate(python_order(order), start=1)}
    got = number_rows(df, order, "n", ranges=7, small_rows=0)
    assert {r.id: r.n for r in got.collect()} == want
    assert got.columns == [*df.columns, "n"]
    assert {r.id: r.n for r in number_rows(df, order, "n").collect()} == want


@pytest.mark.parametrize("order", ORDERS[2:5])
def test_number_rows_per_key(df, order):
    want, seen = {}, {}
    for r in python_order(order):
        seen[r[1]] = seen.get(r[1], 0) + 1
        want[r[0]] = seen[r[1]]
    got = number_rows(df, order, "n", keys=["key"], ranges=7, small_rows=0)
    assert {r.id: r.n for r in got.collect()} == want


def test_ranges_really_split(df):
    order = [("v", "desc"), ("id", "asc")]
    sizes = [r["count"] for r in df.groupBy(range_id(df, order, 8, 0).alias("b")).count().collect()]
    assert len(sizes) >= 5 and max(sizes) < 300


@pytest.mark.parametrize("split", [False, True])
def test_running_depth(spark, split):
    random.seed(11)
    data = [(i, random.choice("abh" + "h" * 3), random.choice([1, -1, -1, 1])) for i in range(400)]
    df = spark.createDataFrame(data, "id bigint, key string, step int")
    if split:
        df = df.withColumn("_range", range_id(df, ["id"], 6, 0))
    got = {r.id: (r.depth_before, r.depth) for r in running_depth(df, "key", ["id"], "step").collect()}
    depth = {}
    for i, key, step in data:
        before = depth.get(key, 0)
        depth[key] = max(0, before + step)
        assert got[i] == (before, depth[key])


def replay(events):
    """Final state of every run by applying the events one after another."""
    runs, changes, state = {}, [], {}
    for at, eid, job, kind in sorted(events):
        batch = []
        runs.setdefault(job, Runs(MapState(), MapState())).apply(at, eid, kind, False, batch)
        changes += [(job, *c) for c in batch]
    for job, run_id, status, started, at in changes:
        state[run_id] = (job, status, started, at)
    return state


@pytest.mark.parametrize("ranges", [{}, {"ranges": 6, "small_rows": 0}])
def test_job_runs_match_the_state_machine(spark, ranges):
    random.seed(3)
    kinds = ["submitted"] * 4 + ["executed", "error", "missed", "removed", "removed", "other"]
    events = [(i // 2, i, 1 if random.random() < 0.5 else random.randrange(2, 9), random.choice(kinds)) for i in range(500)]
    df = spark.createDataFrame([(t, e, j, k) for t, e, j, k in events], "ts bigint, event_id bigint, job_id bigint, kind string")
    got = {r.run_id: (r.job_id, r.status, r.started, r.ended) for r in J.job_runs(df, **ranges).collect()}
    want = replay(events)
    assert set(got) == set(want)
    for run, (job, status, started, at) in want.items():
        assert got[run][:3] == (job, status, started), run
        assert got[run][3] == (None if status == "running" else at), run


def test_active_sessions(spark):
    rows = [("a", 1, "login", 0), ("a", 5, "logout", 1), ("b", 1, "login", 2), ("c", 9, "login", 3), ("d", 50, "login", 4)]
    df = spark.createDataFrame(rows, "session_id string, s int, kind string, event_id int").withColumn(
        "ts", F.timestamp_seconds("s"))
    live = J.active_sessions(df, 8, "1970-01-01 00:00:10")
    assert sorted(r.session_id for r in live.collect()) == ["c"]


@pytest.mark.parametrize("ranges", [{}, {"ranges": 6, "small_rows": 0}])
def test_exact_percentile(df, ranges):
    for by in ([], ["key"]):
        want = df.groupBy(*by).agg(F.percentile("v", 0.9).alias("p"))
        got = exact_percentile(df, "v", 0.9, by, "p", **ranges)
        pick = lambda d: {tuple(r[c] for c in by): round(r.p, 9) for r in d.collect()}
        assert pick(got) == pick(want)


KINDS = {
    "i": ("bigint", [None, -3, 0, 7, 2**62, -2**63]), "d": ("double", [None, -1.5, 0.0, 2.25, float("nan"), float("inf"), -float("inf")]),
    "m": ("decimal(10,2)", [None, "-1.50", "0.00", "3.25"]), "s": ("string", [None, "", "a", "ab", "abc", "b", "É", "zz\x00", "zz"]),
    "b": ("boolean", [None, True, False]), "t": ("timestamp", [None, "1969-12-31 23:59:59.5", "2024-01-02 03:04:05.000006"]),
    "n": ("timestamp_ntz", [None, "1950-01-01 00:00:00", "2024-01-02 03:04:05.000006"]), "y": ("date", [None, "1950-01-01", "2024-02-29"]),
}


@pytest.mark.parametrize("first", list(KINDS))
@pytest.mark.parametrize("lead", ["asc", "desc"])
def test_ranges_over_mixed_directions(spark, first, lead):
    """Any column may go against the first one: positions are those of one plain sort."""
    rng = random.Random(first + lead)
    other = "desc" if lead == "asc" else "asc"
    data = [[i, *[(None if (x := rng.choice(values)) is None else str(x)) for _, values in KINDS.values()]] for i in range(160)]
    df = spark.createDataFrame(data, "id bigint, " + ", ".join(f"{c} string" for c in KINDS))
    df = df.select("id", *[F.col(c).cast(kind).alias(c) for c, (kind, _) in KINDS.items()])
    rest = [c for c in KINDS if c != first]
    rng.shuffle(rest)
    order = [(first, lead), *[(c, rng.choice([other, other, lead])) for c in rest[:3]], ("id", other)]
    got = {r.id: r.row_no for r in number_rows(df, order, ranges=9, small_rows=0).collect()}
    want = {r.id: i + 1 for i, r in enumerate(df.orderBy(*sort_columns(order)).collect())}
    assert got == want


def test_mixed_directions_give_even_ranges(spark):
    """A first column of three values is split by the columns behind it."""
    df = spark.range(20_000).select("id", F.expr("element_at(array('F', 'O', 'P'), int(id % 3) + 1)").alias("status"),
                                    F.expr("pmod(xxhash64(id), 100000) / 7").alias("amount"))
    bucket = range_id(df, [("status", "desc"), ("amount", "asc"), ("id", "asc")], ranges=50, small_rows=0)
    sizes = [r["count"] for r in df.groupBy(bucket.alias("r")).count().collect()]
    assert len(sizes) >= 45 and max(sizes) < 3 * 20_000 / 50


@pytest.mark.parametrize("order", [
    [("ts", "desc"), ("id", "desc")], [("ts", "asc"), ("id", "desc")], [("name", "desc"), ("ts", "asc"), ("id", "asc")],
    [("x", "desc"), ("id", "asc")]])
def test_first_of_key(spark, order):
    """Null keys and values, ties, repeated rows and a key that holds most rows."""
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2, 3, n]), rng.choice([None, "a", "b"]), rng.choice([None, 5, 6, 7]), rng.randrange(40),
             rng.choice(["u", "v", None]), rng.choice([None, 0.5, float("nan"), -1.0])) for n in range(600)]
    df = spark.createDataFrame(rows, "k int, l string, ts int, id int, name string, x double").repartition(5)
    names = df.columns

    def rank(row):
        """Sorts as asked, then the other columns downwards."""
        out = []
        for c, d in [*order, *[(c, "desc") for c in names if c not in ("k", "l") and c not in dict(order)]]:
            v = row[names.index(c)]
            v = (v is not None, v != v if v is not None else False, 0 if v is None or v != v else v)
            out.append((d, v))
        return out

    def before(a, b):
        for (d, x), (_, y) in zip(rank(a), rank(b)):
            if x != y:
                return (x > y) == (d == "desc")
        return False

    want = {}
    for row in rows:
        if row[:2] not in want or before(row, want[row[:2]]):
            want[row[:2]] = row
    got = first_of_key(df, ["k", "l"], order).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.values()))
    assert first_of_key(df.limit(0), ["k", "l"], order).count() == 0


def test_newest_rows_need_no_sort_aggregate(spark):
    df = spark.range(50).selectExpr("id % 4 AS k", "id AS ts", "id AS event_id", "'login' AS kind", "'wide' AS name")
    for frame in (M.latest_per_key(df, ["k"], "ts", "event_id"), P.dedupe(df, ["k"], [("ts", "asc"), ("event_id", "desc")]),
                  J.active_sessions(df.withColumn("ts", F.timestamp_seconds("ts")), 8, "1970-01-01 00:01:00", "k")):
        assert "SortAggregate" not in frame._jdf.queryExecution().executedPlan().toString()


def test_range_key_is_built_once_a_row(df):
    """Not again at every step of the search for its range."""
    found = range_id(df, [("v", "desc"), ("s", "asc")], ranges=8, small_rows=0)
    text = found._jc.toString()
    assert "hex(" in text and "hex(" not in text[text.index("aggregate("):]
