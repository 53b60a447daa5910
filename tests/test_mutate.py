import pytest
from pyspark.sql import functions as F

from tablegov.operators import diff as D
from tablegov.operators import mutate as U
from tablegov.operators import quality as Q
from tablegov.operators import relate as R
from tablegov.spec import Ctx, TableSpec

SPEC = TableSpec("t")
CTX = Ctx(user_id=9, tenant_id=1)
SECOND = Ctx(user_id=9, tenant_id=2)
NOW = "2024-01-01 00:00:00"
DDL = ("id bigint, name string, tenant_id bigint, status string, is_deleted boolean, deleted_time timestamp_ntz, "
       "deleted_id bigint, created_id bigint, updated_id bigint, created_time timestamp_ntz, updated_time timestamp_ntz")


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(
        [(i, f"n{i}", 1 + i % 2, "0", False, None, None, 1, 1, None, None) for i in range(6)], DDL)


def test_delete_restore_is_identity(df, rows):
    gone = U.soft_delete(df, [0, 2, 3], SPEC, CTX, NOW)
    assert sorted(r.id for r in gone.filter("is_deleted").collect()) == [0, 2]
    assert {r.deleted_id for r in gone.filter("is_deleted").collect()} == {9}
    assert rows(U.restore(gone, [0, 2, 3], SPEC, CTX)) == rows(df)


def test_hard_delete_and_clear(df):
    hard = TableSpec("t", deleted_id=None)
    assert sorted(r.id for r in U.soft_delete(df, [0, 1], hard, CTX).collect()) == [1, 2, 3, 4, 5]
    assert sorted(r.id for r in U.clear(df, hard, CTX).collect()) == [1, 3, 5]
    assert U.clear(df, SPEC, CTX, NOW).filter("is_deleted").count() == 3
    with pytest.raises(ValueError):
        U.restore(df, [1], hard, CTX)


def test_update(df):
    changes = df.sparkSession.createDataFrame([(0, "x", None), (1, "y", "1"), (77, "z", "1")], "id bigint, name string, status string")
    out, refused = U.update(df, changes, SPEC, CTX, NOW)
    got = {r.id: r for r in out.collect()}
    assert (got[0].name, got[0].status, got[0].updated_id, str(got[0].updated_time)) == ("x", "0", 9, NOW)
    assert (got[1].name, got[1].updated_id) == ("n1", 1)
    assert {r.id: r.reason for r in refused.collect()} == {1: "foreign_tenant", 77: "not_found"}


def test_create(df):
    new = df.sparkSession.createDataFrame([("b", None), ("a", "1")], "name string, status string")
    out = {r.name: r for r in U.create(df, new, SPEC, CTX, ["name"], NOW).collect()}
    assert (out["a"].id, out["b"].id) == (6, 7)
    assert (out["a"].status, out["b"].status, out["b"].tenant_id, out["b"].created_id, out["b"].is_deleted) == ("1", "0", 1, 9, False)
    assert str(out["b"].created_time) == NOW


def test_set_and_toggle(df):
    out = {r.id: r.status for r in U.set_values(df, [0, 1], {"status": "5"}, SPEC, CTX).collect()}
    assert (out[0], out[1]) == ("5", "0")
    out = {r.id: r.status for r in U.toggle(df, "status", [0, 1], SPEC, Ctx(is_super=True)).collect()}
    assert (out[0], out[1], out[2]) == ("1", "1", "0")


def test_upsert(spark, rows):
    df = spark.createDataFrame([(1, "a", "x", "string"), (1, "b", "y", "bool")], "tenant_id int, key string, value string, type string")
    new = spark.createDataFrame([(1, "a", "z", None), (2, "a", "q", None)], "tenant_id int, key string, value string, type string")
    assert rows(U.upsert(df, new, ["tenant_id", "key"], {"type": "string"})) == [
        (1, "a", "z", "string"), (1, "b", "y", "bool"), (2, "a", "q", "string")]


@pytest.mark.parametrize("update", [False, True])
def test_import(spark, update):
    spec = TableSpec("t", tenant=None, creator=None, updater=None, created_time=None, updated_time=None, deleted=None)
    df = spark.createDataFrame([(1, "old", "0", False), (2, "root", "0", True)], "id bigint, name string, status string, is_superuser boolean")
    new = spark.createDataFrame([("old", "1", 1), ("new", "1", 2), ("root", "1", 3), ("new", "0", 4)], "name string, status string, row_no bigint")
    out, report = U.import_upsert(df, new, "name", update, spec, CTX, F.col("is_superuser"))
    want = {1: "updated" if update else "exists", 2: "created", 3: "refused", 4: "updated" if update else "exists"}
    assert {r.row_no: r.outcome for r in report.collect()} == want
    got = {r.name: (r.id, r.status) for r in out.collect()}
    assert got == {"old": (1, "1" if update else "0"), "root": (2, "0"), "new": (3, "0" if update else "1")}
    summary = Q.import_summary(report).first()
    assert (summary.success_count, summary.error_count) == ((3, 1) if update else (1, 3))


def test_links(spark, rows):
    links = spark.createDataFrame([(1, 1, False), (2, 1, False), (3, 2, True), (4, 2, False)], "id int, user_id int, is_default boolean")
    assert sorted(r.id for r in U.first_default(links).filter("is_default").collect()) == [1, 3]
    assert sorted(r.id for r in U.exclusive_default(links, 2, 4).filter("is_default").collect()) == [4]
    pairs = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "r int, m int")
    new = spark.createDataFrame([(1, 12), (3, 1)], "r int, m int")
    assert rows(U.replace_children(pairs, "r", spark.createDataFrame([(1,), (2,)], "id int"), new)) == [(1, 12)]
    owners = spark.createDataFrame([(1, 1, True), (1, 2, True), (2, 1, True), (3, 1, False)], "tenant_id int, user_id int, is_owner boolean")
    gone = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "tenant_id int, user_id int")
    assert [r.tenant_id for r in U.last_owner_guard(owners, gone).collect()] == [2]


def test_expire(spark):
    data = [(1, "0", "2024-01-01 00:00:00"), (2, "0", "2024-01-02 00:00:00"), (3, "0", "2024-01-02 00:00:01"), (4, "0", "2024-01-09 00:00:00"),
            (5, "0", "2024-02-09 00:00:00"), (6, "0", None), (7, "1", "2023-01-01 00:00:00")]
    df = spark.createDataFrame(data, "id int, status string, e string").withColumn("end_time", F.col("e").cast("timestamp_ntz"))
    got = {r.id: (r.status, r.notice_days) for r in U.expire(df, NOW).collect()}
    assert got == {1: ("1", None), 2: ("0", 1), 3: ("0", 7), 4: ("0", 30), 5: ("0", None), 6: ("0", None), 7: ("1", None)}


def test_diff(spark, df, rows):
    assert D.snapshot_diff(df, df, ["id"]).isEmpty()
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1)], "id int, x string, y int")
    new = spark.createDataFrame([(1, "a", None), (2, "B", None), (4, "d", 1)], "id int, x string, y int")
    assert rows(D.snapshot_diff(old, new, ["id"])) == [(2, "changed", ["x", "y"]), (3, "removed", []), (4, "added", [])]
    came, went = D.row_diff(old.unionByName(old), old)
    assert came.isEmpty() and went.count() == 3


def test_chunks_are_whole(spark):
    """A hot parent continues in further rows; nothing is lost, order is kept."""
    child = spark.createDataFrame([(i, 1 if i % 3 else i) for i in range(100)], "id bigint, fk bigint")
    parents = spark.createDataFrame([(1,), (999,)], "id bigint")
    out = R.with_many(parents, child, "fk", [("id", "desc")], ["id"], chunk=10).orderBy("id", "chunk_no").collect()
    hot = [c.id for r in out if r.id == 1 for c in r.children]
    assert hot == [i for i in range(99, -1, -1) if i % 3]
    assert max(len(r.children) for r in out) == 10
    assert [(r.chunk_no, r.children) for r in out if r.id == 999] == [(0, [])]


def test_relations(spark, rows):
    users = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    one = R.with_one(spark.createDataFrame([(7, 1), (8, 5), (9, None)], "k int, by int"), users, "by", "who")
    assert {r.k: (r.who.name if r.who else None) for r in one.collect()} == {7: "a", 8: None, 9: None}
    again = R.page_with_one(spark.createDataFrame([(7, 1), (8, 5), (9, None)], "k int, by int"), users, "by", "who")
    assert rows(again) == rows(one)
    tenants = spark.createDataFrame([(1, "t1", "0", 2, False), (2, "t2", "1", 1, False), (3, "t3", "0", 1, False)],
                                    "id int, name string, status string, sort int, is_deleted boolean")
    links = spark.createDataFrame([(5, 1, True), (5, 2, False), (5, 3, False)], "user_id int, tenant_id int, is_default boolean")
    assert [r.id for r in R.tenant_options(links, tenants, 5).collect()] == [1, 3]
    assert [r.id for r in R.tenant_options(links, tenants, 5, is_super=True).collect()] == [3, 1]
    pairs = spark.createDataFrame([(5, 1), (5, 2), (6, 1)], "user_id int, tenant_id int")
    assert rows(R.member_of(pairs, links, tenants).select("user_id", "tenant_id")) == [(5, 1)]
    target = spark.createDataFrame([(1, "x")], "k int, v string")
    more = spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    assert rows(R.insert_missing(target, more, ["k"])) == [(1, "x"), (2, "z")]


def test_guarded_delete(spark, rows):
    df = spark.createDataFrame([(1, True, 2), (2, False, 2), (3, False, 2), (4, False, 3)], "id int, locked boolean, tenant_id int")
    kept, refused = U.guarded_delete(df, [1, 2, 9, 4], [(F.col("locked"), "locked"), (F.col("id") == 1, "self")], SPEC, SECOND)
    assert sorted(r.id for r in kept.collect()) == [1, 3, 4] and rows(refused) == [(1, "locked"), (4, "foreign_tenant")]


def test_repeated_and_cleared_changes(df):
    changes = df.sparkSession.createDataFrame([(0, None), (2, "a"), (2, "b")], "id bigint, name string")
    out, refused = U.update(df, changes, SPEC, CTX, NOW, given=["name"])
    got = {r.id: r.name for r in out.collect()}
    assert out.count() == df.count() and got[0] is None and got[2] == "n2"
    assert [(r.id, r.reason) for r in refused.collect()] == [(2, "repeated")] * 2
    inside, refused = U.update(df, changes.limit(1), SPEC, CTX, NOW, scope=F.col("id") > 100)
    assert [r.reason for r in refused.collect()] == ["out_of_scope"]


def test_upsert_keeps_tenants_apart(spark, rows):
    df = spark.createDataFrame([("a", 2, "x"), ("b", 3, "y")], "k string, tenant_id int, v string")
    new = spark.createDataFrame([("a", 2, "p"), ("a", 2, "q"), ("b", 3, "stolen"), ("c", None, "n")], df.schema)
    assert rows(U.upsert(df, new, ["k"], None, TableSpec("t"), SECOND)) == [("a", 2, "q"), ("b", 3, "y"), ("c", 2, "n")]


def test_import_stays_in_the_tenant(spark, rows):
    df = spark.createDataFrame([(1, "a", 2, "0"), (2, "b", 3, "0"), (3, "a", 2, "1")], "id bigint, name string, tenant_id int, status string")
    new = spark.createDataFrame([("a", 9, "5", 1), ("b", 9, "5", 2)], "name string, tenant_id int, status string, row_no long")
    spec = TableSpec("t", creator=None, updater=None, created_time=None, updated_time=None, deleted=None)
    out, report = U.import_upsert(df, new, "name", True, spec, SECOND)
    assert rows(out) == [(1, "a", 2, "5"), (2, "b", 3, "0"), (3, "a", 2, "5"), (4, "b", 2, "5")]
    assert rows(report) == [(1, "a", "updated"), (2, "b", "created")]


def test_import_writes_rows_one_after_another(spark, rows):
    """Nulls take nothing away, and a deleted row is neither changed nor doubled."""
    ddl = "id bigint, name string, a string, b string, is_deleted boolean"
    df = spark.createDataFrame([(1, "k1", "old", "old", False), (2, "gone", "old", "old", True), (3, "back", "x", "x", True),
                                (4, "back", "y", "y", False)], ddl)
    new = spark.createDataFrame([("k1", "first", None, 1), ("k1", None, "second", 2), ("k2", "p", None, 3), ("k2", None, "q", 4), ("k2", "r", None, 5),
                                 ("gone", "z", "z", 6), ("back", "z", None, 7)], "name string, a string, b string, row_no bigint")
    spec = TableSpec("t", tenant=None, creator=None, updater=None, created_time=None, updated_time=None)
    out, report = U.import_upsert(df, new, "name", True, spec, CTX)
    assert [(r.id, r.name, r.a, r.b) for r in out.orderBy("id").collect()] == [
        (1, "k1", "first", "second"), (2, "gone", "old", "old"), (3, "back", "x", "x"), (4, "back", "z", "y"), (5, "k2", "r", "q")]
    assert [o for *_, o in rows(report)] == ["updated", "updated", "created", "updated", "updated", "deleted", "updated"]


def test_upsert_in_order(spark, rows):
    df = spark.createDataFrame([("a", "old", "old")], "k string, x string, y string")
    new = spark.createDataFrame([("a", "2", None, 2), ("a", "1", "1", 1), ("b", None, "z", 1), ("b", "w", None, 2)], "k string, x string, y string, no int")
    assert rows(U.upsert(df, new, ["k"], order="no")) == [("a", "2", "1"), ("b", "w", "z")]


def test_sync_columns(spark):
    ddl = "column_name string, column_type string, is_pk boolean, is_nullable boolean, is_list boolean, query_type string, html_type string"
    cur = spark.createDataFrame([("id", "int", True, False, True, "EQ", "input"), ("a", "int", False, False, False, "", "select"), ("gone", "x", False, True, True, "EQ", "input")], ddl)
    inc = spark.createDataFrame([("id", "bigint", True, False, True, "EQ", "input"), ("a", "bigint", False, True, True, "LIKE", "textarea"), ("new", "int", False, True, True, "EQ", "input")], ddl)
    got = {r.column_name: r[1:] for r in D.sync_columns(cur, inc, ["column_name"]).collect()}
    assert got == {"id": ("bigint", True, False, False, None, "input"), "a": ("bigint", False, False, False, "LIKE", "select"),
                   "new": ("int", False, True, True, "EQ", "input")}


def test_insert_missing_pairs(spark, rows, monkeypatch):
    """Pairs of two tables are made, told apart and compared without a shuffle of the
    pairs, whatever repeats or is null; also where every value is dealt over parts."""
    menus = spark.createDataFrame([(1, 7), (1, 7), (1, 8), (2, 8), (3, None), (None, 7), (4, 9)], "m int, n int")
    roles = spark.createDataFrame([(5, 7), (5, 8), (6, 8), (6, 8), (None, 8), (9, None)], "r int, n int")
    target = spark.createDataFrame([(5, 2), (6, 1), (None, 2), (8, 8)], "r int, m int")
    plain = menus.join(roles, "n").select("r", "m").distinct()
    want = rows(R.insert_missing(target, plain, ["r", "m"]))
    for most in (R.PAIRS, 0):
        monkeypatch.setattr(R, "PAIRS", most or 1)
        got = R.insert_missing(target, menus, ["m", "r"], roles, "n")
        assert rows(got) == want and got.columns == ["r", "m"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan


def test_describe_tables_joins_comments_first(spark, rows, monkeypatch):
    """A namespace shared by many tables and rows is dealt over parts."""
    tables = spark.createDataFrame([(i, i % 3) for i in range(30)] + [(None, 1), (4, 1), (40, None)], "table_id int, namespace_id int")
    spaces = spark.createDataFrame([(i % 2, f"s{i}") for i in range(20)] + [(None, "x")], "namespace_id int, namespace string")
    comments = spark.createDataFrame([(1, "a"), (1, "b"), (4, "c"), (None, "d")], "table_id int, comment string")
    plain = tables.join(spaces, "namespace_id").join(comments, "table_id", "left").withColumn("comment", F.coalesce("comment", F.lit("")))
    for most in (R.PAIRS, 3):
        monkeypatch.setattr(R, "PAIRS", most)
        got = R.describe_tables(tables, spaces, comments)
        assert rows(got) == rows(plain) and got.columns == plain.columns
    # The comments are joined below the namespaces.
    lines = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert "Inner" in lines[0] and "LeftOuter" in lines[1]


def test_spread_join_repeats_few_rows(spark, rows, monkeypatch):
    """A value of many pairs is dealt over a grid, so its rows are repeated by the root of the
    cells only, and rows that follow each other have few values."""
    tables = spark.range(600).select(F.col("id").alias("t"), F.lit(1).alias("n"))
    spaces = spark.range(200).select(F.format_string("space %d", "id").alias("s"), F.lit(1).alias("n"))
    monkeypatch.setattr(R, "PAIRS", 1200)
    shuffled, repartition = [], type(tables).repartition
    monkeypatch.setattr(type(tables), "repartition", lambda self, *to: shuffled.append(self) or repartition(self, *to))
    got = R.spread_join(tables, spaces, "n")
    pairs = got.collect()
    assert got.columns == ["n", "t", "s"] and rows(got) == rows(tables.join(spaces, "n"))
    assert len(shuffled) == 2 and sum(df.count() for df in shuffled) < 8_000
    last, far = {}, 0
    for at, row in enumerate(pairs):
        far += at - last.get(row["s"], -1_000) > 64
        last[row["s"]] = at
    assert far < len(pairs) / 10
