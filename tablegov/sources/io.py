"""Readers and writers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegov.operators.conditions import where
from tablegov.operators.ordering import number_rows
from tablegov.session import sized


def _or_none(load) -> DataFrame | None:
    """``None`` when the path is not there."""
    try:
        return load()
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_seed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON array file; a missing file gives an empty frame."""
    found = _or_none(lambda: spark.read.schema(schema).json(path, multiLine=True))
    return spark.createDataFrame([], schema) if found is None else found


def flatten_children(df: DataFrame, key: str, child: str = "children", parent: str = "parent_id") -> DataFrame:
    """Nested child arrays to flat rows with a parent link.  The depth is that
    of the declared schema."""
    fields = [f.name for f in df.schema.fields if f.name not in (child, parent)]
    level = df.withColumn(parent, F.lit(None).cast(df.schema[key].dataType))
    out = level.select(*fields, parent)
    while child in level.columns:
        inner = level.schema[child].dataType.elementType
        level = level.select(F.col(key).alias("_up"), F.explode(child).alias("_c"))
        names = [f for f in fields if f in inner.names]
        keep = [F.col(f"_c.{f}").alias(f) for f in names]
        if child in inner.names:
            keep.append(F.col(f"_c.{child}").alias(child))
        level = level.select(*keep, F.col("_up").alias(parent))
        out = out.unionByName(level.select(*names, parent), allowMissingColumns=True)
    return out


def load_if_empty(df: DataFrame, path: str) -> bool:
    """Write only when the target holds no row."""
    have = _or_none(lambda: df.sparkSession.read.schema(df.schema).parquet(path))
    if have is not None and not have.isEmpty():
        return False
    df.write.mode("append").parquet(path)
    return True


# --- databases ----------------------------------------------------------------

# JDBC prefix, driver and port of the supported databases.
DATABASES = {
    "mysql": ("jdbc:mysql://", "com.mysql.cj.jdbc.Driver", 3306),
    "postgres": ("jdbc:postgresql://", "org.postgresql.Driver", 5432),
    "sqlite": ("jdbc:sqlite:", "org.sqlite.JDBC", None),
}


def db_options(kind: str, table: str, database: str, host: str = "localhost", port: int | None = None,
               user: str | None = None, password: str | None = None, partition_column: str | None = None,
               lower=None, upper=None, partitions: int | None = None, fetch_size: int = 10_000) -> dict[str, str]:
    """JDBC reader options; with a partition column the table is read in
    parallel key ranges."""
    if kind not in DATABASES:
        raise ValueError(f"unsupported database: {kind}")
    prefix, driver, default_port = DATABASES[kind]
    url = prefix + database if kind == "sqlite" else f"{prefix}{host}:{port or default_port}/{database}"
    options = {"url": url, "dbtable": table, "driver": driver, "fetchsize": str(fetch_size)}
    if user:
        options |= {"user": user, "password": password or ""}
    if partition_column:
        if lower is None or upper is None or not partitions:
            raise ValueError("a partition column needs lower, upper and partitions")
        options |= {"partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper),
                    "numPartitions": str(partitions)}
    return options


def read_db(spark: SparkSession, kind: str, table: str, database: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**db_options(kind, table, database, **options)).load()


# --- import and export --------------------------------------------------------

def apply_headers(df: DataFrame, headers: dict[str, str]) -> DataFrame:
    """Check that all headers are there and the frame has rows, then rename."""
    missing = [h for h in headers if h not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if df.isEmpty():
        raise ValueError("the import is empty")
    return df.select(*[F.col(f"`{h}`").alias(name) for h, name in headers.items()])


def read_import(spark: SparkSession, path: str, headers: dict[str, str]) -> DataFrame:
    """Tabular upload: CSV with a header line, or Parquet."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        df = spark.read.csv(path, header=True, multiLine=False)
    return apply_headers(df, headers)


def read_checked(spark: SparkSession, path: str, fields: dict[str, tuple[str, str]],
                 required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """A CSV upload as typed rows and as rejects.  ``fields`` maps a header to the
    field's name and type; ``required`` holds names of fields.

    The first frame has ``row_no`` and the fields of every row without a fault.
    The second has a row for every fault: ``row_no``, ``field``, ``value`` and
    ``reason``, which is ``columns`` (more or fewer values than headers; the field
    is null and the value is the whole line), ``required`` or ``type``.  Rows are
    numbered from 1 over all files by their names, header and blank lines apart.

    Numbering moves no row: a row's place in its part of a file comes from the
    scan, and only the counts of the parts are ordered."""
    headers = spark.read.csv(path, header=True).columns
    missing = [h for h in fields if h not in headers]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    line = "_line"
    while line in headers:
        line += "_"
    names = [f"_c{i}" for i in range(len(headers))]
    schema = T.StructType([T.StructField(h, T.StringType()) for h in [*headers, line]])
    # Pruned columns would hide rows with too many or too few values.
    read = spark.read.schema(schema).options(
        header=True, enforceSchema=False, columnNameOfCorruptRecord=line, columnPruning=False).csv(path)
    rows = read.select(*[F.col(f"`{h}`").alias(n) for h, n in zip(headers, names)], F.col(f"`{line}`").alias("_line"),
                       F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"),
                       F.monotonically_increasing_id().alias("_at"))
    parts = rows.groupBy("_file", "_from").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_file", "_from").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_file", "_from", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = rows.join(sized(parts), ["_file", "_from"]).withColumn("row_no", F.col("_at") - F.col("_first") + F.col("_before") + 1)

    def fault(when: Column, field: str | None, value: Column, reason: str) -> Column:
        return F.when(when, F.struct(F.lit(field).cast("string").alias("field"), value.alias("value"),
                                     F.lit(reason).alias("reason")))

    whole = F.col("_line").isNull()
    faults, typed = [fault(~whole, None, F.col("_line"), "columns")], []
    for header, (name, kind) in fields.items():
        value = F.col(names[headers.index(header)])
        typed.append(value.try_cast(kind).alias(name))
        faults.append(fault(whole & value.isNotNull() & value.try_cast(kind).isNull(), name, value, "type"))
        if name in required:
            faults.append(fault(whole & value.isNull(), name, value, "required"))
    rows = rows.withColumn("_faults", F.array_compact(F.array(*faults)))
    return (rows.where(F.size("_faults") == 0).select("row_no", *typed),
            rows.select("row_no", F.inline("_faults")))


def export_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(field).alias(title) for field, title in mapping.items()])


def export_table(df: DataFrame, mapping: dict[str, str], path: str, fmt: str = "csv") -> None:
    """Chosen columns under their titles.  The parts are written in parallel."""
    writer = export_columns(df, mapping).write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def export_rows(df: DataFrame, mode: str, search: dict | None = None, ids: list | None = None, by=None,
                page_no: int = 1, page_size: int = 10, key: str = "id", max_rows: int | None = None) -> DataFrame:
    """Rows of the current page, the selected ids, or the whole filtered set.
    A caller's ``max_rows`` refuses a larger export, which costs one more run of
    the filter; nothing is ever cut off."""
    from tablegov.operators.page import order, rows_at

    if mode == "current":
        return rows_at(where(df, search), (page_no - 1) * page_size, page_size, by or [key], key)
    if mode == "selected":
        rows = where(df, {key: ("in", list(ids or []))})
    elif mode == "remote":
        rows = where(df, search)
    else:
        raise ValueError(f"unknown export mode: {mode}")
    if max_rows is not None and rows.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows to export")
    return order(rows, by or [key], key)


def serialize_columns(df: DataFrame, columns: dict[str, tuple[str, Column | None]], order=None,
                      index: str | None = None) -> DataFrame:
    """Columns under their titles, each through its formatter; ``index`` adds a
    row-number column in ``order``."""
    rows = number_rows(df, order, "_index") if index else df
    cols = [F.col("_index").alias(index)] if index else []
    for name, (title, formatter) in columns.items():
        cols.append((F.col(name) if formatter is None else formatter).cast("string").alias(title))
    return rows.select(*cols)


# --- catalog ------------------------------------------------------------------

def catalog_tables(spark: SparkSession, database: str | None = None, name_like: str | None = None,
                   comment_like: str | None = None) -> DataFrame:
    rows = [(t.name, t.database, t.description or "", t.tableType) for t in spark.catalog.listTables(database)]
    df = spark.createDataFrame(rows, "table_name string, database string, table_comment string, table_type string")
    if name_like:
        df = df.filter(F.col("table_name").ilike(f"%{name_like}%"))
    if comment_like:
        df = df.filter(F.col("table_comment").ilike(f"%{comment_like}%"))
    return df.orderBy("table_name")


def catalog_columns(df: DataFrame, table_name: str, keys: list[str] | None = None,
                    unique: list[str] | None = None) -> DataFrame:
    """Column facts of a frame, one row per column in order."""
    keys, unique = keys or [], unique or []
    rows = [
        (table_name, f.name, f.metadata.get("comment", ""), f.dataType.simpleString(), _length(f.dataType),
         f.metadata.get("default"), i, f.name in keys, f.nullable and f.name not in keys, f.name in keys + unique)
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    return df.sparkSession.createDataFrame(
        rows, "table_name string, column_name string, column_comment string, column_type string, column_length int, "
              "column_default string, sort int, is_pk boolean, is_nullable boolean, is_unique boolean"
    ).withColumn("is_increment", F.lit(False))


def _length(dtype: T.DataType) -> int:
    if isinstance(dtype, (T.VarcharType, T.CharType)):
        return dtype.length
    return dtype.precision if isinstance(dtype, T.DecimalType) else 0


# --- files and logs -----------------------------------------------------------

def scan_files(spark: SparkSession, path: str, hidden: bool = False, name_like: str | None = None) -> DataFrame:
    """Files below a directory.  The content column is never selected, so file
    bodies are not read."""
    from tablegov.functions.files import path_hidden, path_name

    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_time"))
    df = df.withColumn("name", path_name(F.col("path"))).withColumn("is_hidden", path_hidden(F.col("path")))
    if not hidden:
        df = df.filter(~F.col("is_hidden"))
    return df.filter(F.contains(F.lower("name"), F.lit(name_like.lower()))) if name_like else df


APP_LOG_SCHEMA = "text string, record struct<level:struct<name:string>,message:string,time:struct<repr:string,timestamp:double>,name:string,line:int>"


def read_app_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """JSON-lines application log with its event time."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(APP_LOG_SCHEMA).json(path).select(
        F.timestamp_micros((F.col("record.time.timestamp") * 1_000_000).cast("long")).alias("ts"),
        F.col("record.level.name").alias("level"), F.col("record.message").alias("message"),
        F.col("record.name").alias("logger"))


SESSION_SCHEMA = (
    "session_id string, team_id string, user_id string, session_data struct<session_name:string>, "
    "runs array<struct<messages:array<struct<id:string,role:string,content:string,created_at:bigint>>>>, "
    "created_at bigint, updated_at bigint"
)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Chat sessions with nested runs, from Parquet or JSON lines."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(SESSION_SCHEMA).parquet(path)
    return spark.read.schema(SESSION_SCHEMA).json(path)


# --- key-value snapshots ------------------------------------------------------

# A null part of a key, so that it keeps its place.
NULL_PART = r"\N"

def snapshot_kv(df: DataFrame, prefix: str, keys: list[str], fields: list[str], by, chunk: int | None = None,
                ttl_seconds: int | None = None, now: str | None = None) -> DataFrame:
    """``prefix:key:...`` to the JSON array of its entries.  A key with more
    entries than one chunk continues under the next ``chunk_no``."""
    from tablegov.operators.relate import CHUNK, child_chunks

    keyed = df.withColumn("key", F.concat_ws(":", F.lit(prefix), *[F.coalesce(F.col(k).cast("string"), F.lit(NULL_PART)) for k in keys]))
    chunks = child_chunks(keyed, "key", by, fields, chunk or CHUNK)
    out = chunks.select("key", "chunk_no", F.to_json("children").alias("value_json"))
    expires = F.lit(None).cast("timestamp") if ttl_seconds is None else (
        (F.lit(now).cast("timestamp") if now else F.current_timestamp()) + F.expr(f"interval {ttl_seconds} seconds"))
    return out.withColumn("expires_at", expires)


def glob_pattern(glob: str) -> str:
    """Regular expression of a key glob with ``*``, ``?`` and ``[...]``."""
    import re

    out, i = [], 0
    while i < len(glob):
        c, end = glob[i], glob.find("]", i)
        if c == "[" and end > i:
            out.append(glob[i:end + 1])
            i = end
        else:
            out.append({"*": ".*", "?": "."}.get(c) or re.escape(c))
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"


def read_kv(snapshot: DataFrame, schema: str, key: str | None = None, keys: list[str] | None = None,
            glob: str | None = None, now: str | None = None) -> DataFrame:
    """Entries by key, key list or glob that have not expired at ``now``; null
    and unreadable JSON is dropped.  A glob with a fixed start also becomes a
    prefix filter for the scan."""
    rows = snapshot
    if "expires_at" in snapshot.columns:
        at = (F.lit(now) if now else F.current_timestamp()).cast(snapshot.schema["expires_at"].dataType)
        rows = rows.filter(F.col("expires_at").isNull() | (F.col("expires_at") > at))
    if key is not None:
        rows = rows.filter(F.col("key") == key)
    if keys is not None:
        rows = where(rows, {"key": ("in", keys)})
    if glob is not None:
        fixed = glob[:min([glob.find(c) for c in "*?[" if c in glob], default=len(glob))]
        rows = rows.filter(F.col("key").startswith(fixed) & F.col("key").rlike(glob_pattern(glob)))
    readable = rows.filter(F.try_parse_json("value_json").isNotNull())
    parsed = readable.withColumn("value", F.from_json("value_json", schema))
    return parsed.filter(F.col("value").isNotNull()).drop("value_json")


# --- calendar -----------------------------------------------------------------

def date_spine(spark: SparkSession, start: str, end: str, name: str = "day") -> DataFrame:
    """Every day from start to end, both included."""
    return spark.range(1).select(F.explode(F.sequence(
        F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))).alias(name))


def fill_days(df: DataFrame, day: str, values: list[str], start: str, end: str) -> DataFrame:
    """One row per day of the range, zero where ``df`` has none."""
    spine = date_spine(df.sparkSession, start, end, day)
    return spine.join(df, day, "left").select(day, *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


# --- versioned snapshots ------------------------------------------------------

def write_version(df: DataFrame, root: str, version: int, partition_by: list[str] | None = None) -> str:
    """Write the next version of a table beside the old ones, then name it in
    ``CURRENT``.  Readers keep the version they opened.  One writer at a time."""
    path = f"{root.rstrip('/')}/v={version}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    df.sparkSession.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").json(
        f"{root.rstrip('/')}/CURRENT")
    return path


def current_version(spark: SparkSession, root: str) -> int:
    pointer = f"{root.rstrip('/')}/CURRENT"
    written = _or_none(lambda: spark.read.schema("version int").json(pointer))
    return 0 if written is None else written.agg(F.max("version")).first()[0] or 0


def read_current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/v={current_version(spark, root)}")
