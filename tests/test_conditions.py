from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tablegov.operators import conditions as B
from tablegov.operators import page as P


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(
        [(0, "a%b", True, None), (1, "ab", False, "x"), (2, "", True, "y"), (3, None, False, "z")],
        "id int, name string, flag boolean, note string")


@pytest.mark.parametrize("search,ids", [
    ({}, [0, 1, 2, 3]), ({"name": None, "note": ""}, [0, 1, 2, 3]), ({"id": 0}, [0]), ({"flag": False}, [1, 3]),
    ({"id": ("eq", 0)}, [0]), ({"id": ("eq", None)}, [0, 1, 2, 3]), ({"name": ("==", "")}, [2]),
    ({"note": ("None", None)}, [0]), ({"note": ("not None", 1)}, [1, 2, 3]),
    ({"note": ("==", None)}, [0]), ({"note": ("!=", None)}, [1, 2, 3]), ({"note": (">", None)}, []),
    ({"id": ("in", [])}, []), ({"id": ("in", None)}, [0, 1, 2, 3]), ({"id": ("in", {1, 3, None})}, [1, 3]),
    ({"id": ("between", [1, 2])}, [1, 2]), ({"id": ("between", [1])}, [0, 1, 2, 3]),
    ({"name": ("like", "a%b")}, [0, 1]), ({"name": ("like", "")}, [0, 1, 2, 3]),
    ({"name": ("like", B.like_escaped("a%b"))}, [0]), ({"name": ("ilike", "AB")}, [1]),
    ({"id": ("ne", 1), "flag": True}, [0, 2]), ({"note": ("!=", "x")}, [2, 3]),
])
def test_where(df, search, ids):
    assert sorted(r.id for r in B.where(df, search).collect()) == ids


@pytest.mark.parametrize("op,ids", [("eq", 4), ("ne", 4), ("gt", 4), ("ge", 4), ("lt", 4), ("le", 4), ("==", 1), (">", 3)])
def test_falsy_rule(df, op, ids):
    """Words skip 0 when not strict; symbols never do."""
    assert B.where(df, {"id": (op, 0)}, strict=False).count() == ids


def test_errors(df):
    with pytest.raises(ValueError):
        B.where(df, {"nope": 1})
    with pytest.raises(ValueError):
        B.where(df, {"id": ("near", 1)})
    with pytest.raises(ValueError):
        B.preset("job", tenant_id=1)


def test_date_conditions_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("select id, timestamp_ntz'2024-01-31 10:00:00' + make_interval(0,0,0,id) as at from range(5)").write.parquet(path)
    day = B.where(spark.read.parquet(path), {"at": ("date", "2024-02-01")})
    month = B.where(spark.read.parquet(path), {"at": ("month", "2024-02")})
    assert day.count() == 1 and month.count() == 4
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(at" in plan and "LessThan(at" in plan


def test_bundles():
    assert B.base_search("d", "0", ["a"], ["a", "b"]) == {
        "description": ("like", "d"), "status": ("eq", "0"), "updated_time": ("between", ("a", "b"))}
    assert B.by_user(1, None, 0) == {"created_id": ("eq", 1)}
    assert B.preset("user", name="x", created_time=["a", "b"], status="") == {
        "name": ("like", "x"), "created_time": ("between", ("a", "b"))}


def test_order_parsing():
    assert P.parse_order('[{"a": "DESC"}, {"b": "up"}]') == [("a", "desc"), ("b", "asc")]
    assert P.parse_order("nonsense") == P.parse_order(None) == P.parse_order("[]") == [("updated_time", "desc")]


def test_pages_partition_the_sorted_set(spark):
    df = spark.range(57).select("id", (F.col("id") % 5).alias("g"))
    seen = []
    for no in range(1, 7):
        page = P.page(df, no, 10, [("g", "desc")])
        assert page.total == 57 and page.has_next == (no < 6)
        seen += [r.id for r in page.items.collect()]
    want = [r.id for r in df.orderBy(F.col("g").desc(), "id").collect()]
    assert seen == want
    keyset, after = [], None
    while True:
        part = P.keyset_page(df, [("g", "desc")], after, 10).collect()
        if not part:
            break
        keyset += [r.id for r in part]
        after = part[-1].asDict()
    assert keyset == want


def test_deep_pages_equal_shallow_ones(spark, monkeypatch):
    df = spark.range(57).select("id", (F.col("id") % 5).alias("g"))
    shallow = [r.id for r in P.page(df, 3, 10, [("g", "desc")]).items.collect()]
    monkeypatch.setattr(P, "DEEP_OFFSET", 0)
    assert [r.id for r in P.page(df, 3, 10, [("g", "desc")]).items.collect()] == shallow
    assert P.page(df, 9, 10).items.collect() == []


def test_page_bounds(spark):
    df = spark.range(3)
    for no, size in [(0, 10), (1, 0), (1, 101)]:
        with pytest.raises(ValueError):
            P.page(df, no, size)


def test_sort_items_directions(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "name string, size int")
    conds = [{"field": "size", "direction": "desc"}, {"field": "name"}]
    assert [r.name for r in P.sort_items(df, conds).collect()] == ["c", "a", "b"]
    assert [r.name for r in P.sort_items(df, conds, first_direction_for_all=True).collect()] == ["c", "b", "a"]
    assert [r.name for r in P.sort_items(df, None).collect()] == ["a", "b", "c"]


def test_block_reasons(spark):
    log = spark.createDataFrame(
        [(1, "1.1.1.1", "GET", "/a"), (2, "2.2.2.2", "POST", "/a"), (3, "3.3.3.3", "POST", "/a"), (4, "2.2.2.2", "POST", "/ok"),
         (5, "2.2.2.2", "GET", "/a")], "id int, ip string, method string, path string")
    lists = [spark.createDataFrame([(x,)], "v string") for x in ("1.1.1.1", "3.3.3.3", "/ok")]
    got = {r.id: r.block_reason for r in B.block_requests(log, *lists, demo=True).collect()}
    assert got == {1: "ip_black_list", 2: "demo_mode", 3: None, 4: None, 5: None}
    got = {r.id: r.block_reason for r in B.block_requests(log, *lists, demo=False).collect()}
    assert got == {1: "ip_black_list", 2: None, 3: None, 4: None, 5: None}


def test_long_list_keeps_columns_and_types(spark):
    df = spark.createDataFrame([("a", 1, 0.5, "2024-01-01 00:00:00"), ("b", 2000, 3.0, "2024-01-02 00:00:00")],
                               "name string, id int, x double, at string").withColumn("at", F.col("at").cast("timestamp"))
    for size in (900, 1500):
        got = B.where(df, {"id": ("in", [*range(size), 2.5])})
        assert got.columns == ["name", "id", "x", "at"] and [r.name for r in got.collect()] == ["a"]
        assert [r.name for r in B.where(df, {"x": ("in", list(range(size)))}).collect()] == ["b"]
        days = [f"2023-{1 + i % 12:02}-{1 + i % 28:02} 00:{i // 60 % 60:02}:{i % 60:02}" for i in range(size)]
        assert [r.name for r in B.where(df, {"at": ("in", [*days, "2024-01-02 00:00:00"])}).collect()] == ["b"]


def test_long_list_leaves_out_fractions_of_any_type(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    for size in (900, 1500):
        odd = [Decimal("1.5"), Decimal("NaN"), Decimal("Infinity"), float("inf"), Fraction(5, 2)] if size > 1000 else [Decimal("1.5")]
        got = B.where(df, {"id": ("in", [*range(10, 10 + size), *odd, Decimal("3.0")])})
        assert [r.id for r in got.collect()] == [3]
