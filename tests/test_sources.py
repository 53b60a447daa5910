import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegov.sources import io as A


def test_seed_and_children(spark, tmp_path, rows):
    path = tmp_path / "seed.json"
    path.write_text('[{"id": 1, "name": "a", "children": [{"id": 2, "name": "b", "children": [{"id": 3, "name": "c"}]}, {"id": 4, "name": "d"}]}]')
    leaf = "struct<id:int,name:string>"
    schema = T.StructType.fromDDL(f"id int, name string, children array<struct<id:int,name:string,children:array<{leaf}>>>")
    flat = A.flatten_children(A.read_seed(spark, str(path), schema), "id")
    assert rows(flat) == [(1, "a", None), (2, "b", 1), (3, "c", 2), (4, "d", 1)]
    assert A.read_seed(spark, str(tmp_path / "none.json"), schema).isEmpty()


def test_load_if_empty(spark, tmp_path):
    path = str(tmp_path / "t")
    assert A.load_if_empty(spark.range(3), path)
    assert not A.load_if_empty(spark.range(5), path)
    assert spark.read.parquet(path).count() == 3


def test_db_options():
    o = A.db_options("mysql", "sys_user", "app", "h", user="u", partition_column="id", lower=1, upper=9, partitions=4)
    assert o["url"] == "jdbc:mysql://h:3306/app" and o["numPartitions"] == "4" and o["partitionColumn"] == "id"
    assert A.db_options("sqlite", "t", "/x.db")["url"] == "jdbc:sqlite:/x.db"
    assert A.db_options("postgres", "t", "d", port=1)["url"] == "jdbc:postgresql://localhost:1/d"
    for bad in [("oracle", {}), ("mysql", {"partition_column": "id"})]:
        with pytest.raises(ValueError):
            A.db_options(bad[0], "t", "d", **bad[1])


def test_import_and_export(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string")
    path = str(tmp_path / "out")
    A.export_table(df, {"name": "名称", "id": "编号"}, path)
    back = A.read_import(spark, path, {"编号": "id", "名称": "name"})
    assert rows(back) == [("1", "x"), ("2", "y")] and back.columns == ["id", "name"]
    with pytest.raises(ValueError):
        A.read_import(spark, path, {"状态": "status"})
    with pytest.raises(ValueError):
        A.apply_headers(df.limit(0), {"id": "id"})


def test_checked_import(spark, tmp_path, rows):
    """Typed rows and one reject per fault, numbered over the files."""
    home = tmp_path / "up"
    home.mkdir()
    (home / "a.csv").write_text("编号,_line,extra,金额\n1,x,,1.50\n2,,e,oops\n3,x\n\n4,x,,2.5,more\n,y,,3\n")
    (home / "b.csv").write_text("编号,_line,extra,金额\nseven,,,none\n8,z,,\n")
    fields = {"金额": ("amount", "decimal(9,2)"), "编号": ("id", "int"), "_line": ("row", "string")}
    good, rejects = A.read_checked(spark, str(home), fields, ("id", "row"))
    assert [(r[0], float(r[1]) if r[1] else None, *r[2:]) for r in rows(good)] == [(1, 1.5, 1, "x"), (7, None, 8, "z")]
    assert sorted(map(tuple, rejects.collect()), key=str) == sorted([
        (2, "amount", "oops", "type"), (2, "row", None, "required"), (3, None, "3,x", "columns"),
        (4, None, "4,x,,2.5,more", "columns"), (5, "id", None, "required"), (6, "amount", "none", "type"),
        (6, "id", "seven", "type"), (6, "row", None, "required")], key=str)
    assert good.count() == 2 and rejects.select("reason").count() == 8 and good.columns == ["row_no", "amount", "id", "row"]
    with pytest.raises(ValueError):
        A.read_checked(spark, str(home), {"状态": ("status", "string")})
    (home / "a.csv").write_text("编号,_line,extra,金额\n")
    (home / "b.csv").write_text("编号,_line,extra,金额\n")
    good, rejects = A.read_checked(spark, str(home), fields)
    assert good.isEmpty() and rejects.isEmpty()


def test_checked_import_numbers_many_parts(spark, tmp_path, rows):
    """Files of several parts: the numbers follow the files."""
    path = str(tmp_path / "many")
    spark.range(5000).select(F.col("id").cast("string").alias("no"), F.repeat(F.lit("x"), 40).alias("pad")).repartitionByRange(
        3, F.col("no").cast("int")).sortWithinPartitions(F.col("no").cast("int")).write.option("header", True).csv(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        good, _ = A.read_checked(spark, path, {"no": ("no", "bigint")})
        assert good.where("row_no = no + 1").count() == good.count() == 5000
        assert good.rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_export_rows(spark):
    df = spark.range(20)
    assert [r.id for r in A.export_rows(df, "current", page_no=2, page_size=5).collect()] == [5, 6, 7, 8, 9]
    assert [r.id for r in A.export_rows(df, "selected", ids=[7, 3]).collect()] == [3, 7]
    assert A.export_rows(df, "selected", ids=[]).count() == 0
    assert A.export_rows(df, "remote", {"id": (">", 15)}).count() == 4
    with pytest.raises(ValueError):
        A.export_rows(df, "remote", max_rows=19)
    with pytest.raises(ValueError):
        A.export_rows(df, "other")


def test_kv(spark, rows):
    df = spark.createDataFrame([(1, "sex", 2, "f"), (1, "sex", 1, "m"), (2, "sex", 1, "m"), (1, "a_b", 1, "q")],
                               "tenant int, kind string, sort int, label string")
    snap = A.snapshot_kv(df, "dict", ["tenant", "kind"], ["label"], ["sort", "label"])
    assert {r.key: r.value_json for r in snap.collect()} == {
        "dict:1:sex": '[{"label":"m"},{"label":"f"}]', "dict:2:sex": '[{"label":"m"}]', "dict:1:a_b": '[{"label":"q"}]'}
    bad = snap.unionByName(spark.createDataFrame([("dict:1:bad", 0, "{oops", None), ("dict:1:null", 0, None, None)], snap.schema))
    schema = "array<struct<label:string>>"
    keys = lambda d: sorted(r.key for r in d.collect())
    assert keys(A.read_kv(bad, schema, glob="dict:1:*")) == ["dict:1:a_b", "dict:1:sex"]
    assert keys(A.read_kv(bad, schema, glob="dict:?:s[ae]x")) == ["dict:1:sex", "dict:2:sex"]
    assert keys(A.read_kv(bad, schema, key="dict:2:sex")) == ["dict:2:sex"]
    assert keys(A.read_kv(bad, schema, keys=["dict:2:sex", "none"])) == ["dict:2:sex"]


def test_catalog(spark):
    spark.range(1).createOrReplaceTempView("Gov_Users")
    try:
        names = [r.table_name for r in A.catalog_tables(spark, name_like="USERS").collect()]
        assert [n.lower() for n in names] == ["gov_users"]
    finally:
        spark.catalog.dropTempView("Gov_Users")
    df = spark.createDataFrame([], "id bigint, price decimal(10,2), name string")
    cols = {r.column_name: r for r in A.catalog_columns(df, "t", ["id"], ["name"]).collect()}
    assert (cols["id"].is_pk, cols["id"].is_nullable, cols["price"].column_length, cols["name"].is_unique) == (True, False, 10, True)
    assert [cols[c].sort for c in ("id", "price", "name")] == [1, 2, 3]


def test_files_and_log(spark, tmp_path, rows):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("hello")
    (tmp_path / "d" / "B.log").write_text('{"text": "t", "record": {"level": {"name": "INFO"}, "message": "m", "time": {"repr": "r", "timestamp": 1.5}, "name": "n", "line": 1}}')
    assert rows(A.scan_files(spark, str(tmp_path)).select("name", "size"))[1] == ("a.txt", 5)
    assert A.scan_files(spark, str(tmp_path), name_like="b.L").count() == 1
    log = A.read_app_log(spark, str(tmp_path / "d" / "B.log")).first()
    assert (log.level, log.message, log.ts.microsecond) == ("INFO", "m", 500000)


def test_sessions(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{"session_id": "s1", "runs": [{"messages": [{"role": "user", "content": "hi"}, {"role": "system", "content": "x"}]}, {}], "updated_at": 5}')
    from tablegov.functions.content import messages_of

    df = A.read_sessions(spark, str(path))
    assert [m.content for m in df.select(messages_of(F.col("runs")).alias("m")).first().m] == ["hi"]


def test_spine(spark):
    days = [str(r.day) for r in A.date_spine(spark, "2023-12-30", "2024-01-02").collect()]
    assert days == ["2023-12-30", "2023-12-31", "2024-01-01", "2024-01-02"]


def test_versions(spark, tmp_path):
    root = str(tmp_path / "table")
    assert A.current_version(spark, root) == 0
    A.write_version(spark.range(3), root, 1)
    old = A.read_current(spark, root)
    A.write_version(spark.range(5), root, 2)
    assert (old.count(), A.read_current(spark, root).count(), A.current_version(spark, root)) == (3, 5, 2)
    with pytest.raises(Exception):
        A.write_version(spark.range(1), root, 2)


def test_serialize(spark, rows):
    df = spark.createDataFrame([(1, True), (2, False)], "id int, ok boolean")
    out = A.serialize_columns(df, {"id": ("Id", None), "ok": ("State", F.when(F.col("ok"), "yes").otherwise("no"))}, [("id", "desc")], "No")
    assert rows(out) == [(1, "2", "no"), (2, "1", "yes")] and out.columns == ["No", "Id", "State"]
