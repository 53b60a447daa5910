"""Positions and running values over one long order.

A window without (or with a hot) partition key would sort everything in one
task.  Here the order is cut into ranges by sampled bounds: each range is
handled by its own task, and a small frame of per-range totals carries the
offset.  The bounds are literals, so both passes agree and the result is exact
whatever the sample was.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Up to this many rows one task sorts the data quicker than two passes do.
SMALL_ROWS = 200_000

_SAMPLES_PER_RANGE = 20

# A range holds about this many rows at most; there are never fewer ranges than shuffle partitions.
_ROWS_PER_RANGE = 5_000_000

Order = list[tuple[str, str]]


def normalise(order) -> Order:
    """Accepts ``[{"a": "desc"}, ...]``, ``[("a", "desc")]`` or ``["a"]``;
    anything but "desc" is ascending."""
    out: Order = []
    for item in order or []:
        pairs = item.items() if isinstance(item, dict) else [item if isinstance(item, tuple) else (item, "asc")]
        out += [(c, "desc" if str(d).lower() == "desc" else "asc") for c, d in pairs]
    return out


def sort_columns(order) -> list[Column]:
    return [F.col(c).desc() if d == "desc" else F.col(c).asc() for c, d in normalise(order)]


def _reversed(col: Column, kind: T.DataType) -> list[Column]:
    """Fields that order like ``col`` the other way round, its nulls at the end."""
    fields = [col.isNull()]
    if isinstance(kind, T.IntegralType):
        fields.append(F.bitwise_not(col))
    elif isinstance(kind, T.FractionalType):
        if not isinstance(kind, T.DecimalType):
            # NaN is above all numbers and has no sign.
            fields.append(~F.isnan(col))
        fields.append(-col)
    elif isinstance(kind, T.BooleanType):
        fields.append(~col)
    elif isinstance(kind, T.DateType):
        fields.append(-F.unix_date(col))
    elif isinstance(kind, T.TimestampType):
        fields.append(-F.unix_micros(col))
    elif isinstance(kind, T.TimestampNTZType):
        fields.append(-F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col))
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        # The digits of every byte are complemented; the end of a value comes after all digits.
        fields.append(F.concat(F.translate(F.hex(col), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G")))
    else:
        raise TypeError(f"no order for a column of type {kind.simpleString()}")
    return fields


def _range_key(df: DataFrame, order: Order) -> Column:
    """A struct that orders like all sort columns, in the direction of the first."""
    lead = order[0][1]
    fields: list[Column] = []
    for name, direction in order:
        fields += [F.col(name)] if direction == lead else _reversed(F.col(name), df.schema[name].dataType)
    return F.struct(*[field.alias(f"k{i}") for i, field in enumerate(fields)])


def range_id(df: DataFrame, order, ranges: int | None = None, small_rows: int | None = None,
             keys: list[str] | None = None) -> Column | None:
    """Number of the range a row falls in, rising in sort order; ``None`` when
    no task would have to sort more than ``small_rows`` rows: of the whole
    input, or of the largest key."""
    order = normalise(order)
    limit = SMALL_ROWS if small_rows is None else small_rows
    counts = df.groupBy(*(keys or [])).count()
    rows, largest = counts.agg(F.sum("count"), F.max("count")).first()
    if (largest or 0) <= limit:
        return None
    spark = df.sparkSession
    ranges = ranges or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // _ROWS_PER_RANGE))
    key = _range_key(df, order)
    keys = df.select(key.alias("k")).select("k.*")
    sample = keys.sample(min(1.0, ranges * _SAMPLES_PER_RANGE / rows), seed=7)
    picked = sample.orderBy(*keys.columns).select(
        *[F.col(c).cast("string") for c in keys.columns]).collect()
    bounds = picked[::_SAMPLES_PER_RANGE][1:]
    if not bounds:
        return F.lit(0)
    types = [f.dataType for f in keys.schema.fields]
    # One text literal, whatever the number of bounds; the optimizer folds it into one array.
    text = json.dumps([dict(zip(keys.columns, row)) for row in bounds])
    names = keys.columns
    literal = F.from_json(F.lit(text), "array<struct<" + ",".join(f"{c}:string" for c in names) + ">>").cast(
        "array<struct<" + ",".join(f"{c}:{t.simpleString()}" for c, t in zip(names, types)) + ">>")
    step = 1
    while step * 2 <= len(bounds):
        step *= 2
    steps = []
    while step:
        steps.append(step)
        step //= 2
    # The key is bound as a lambda variable: named in the inner lambda it would be built again at every step.
    found = F.get(F.transform(F.array(key), lambda own: F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, jump: F.when(F.get(literal, at + jump - 1) <= own, at + jump).otherwise(at),
    )), F.lit(0))
    return found if order[0][1] == "asc" else -found


def number_rows(df: DataFrame, order, name: str = "row_no", keys: list[str] | None = None,
                ranges: int | None = None, small_rows: int | None = None, weight: str | None = None) -> DataFrame:
    """1-based position of each row in ``order`` (within ``keys``, which must
    not be null).  ``order`` has to end in a unique column for a stable result.
    With ``weight`` a row stands for that many, and has the position of its last."""
    bucket = range_id(df, order, ranges, small_rows, keys)
    cut = df if bucket is None else df.withColumn("_range", bucket)
    return number_in_ranges(cut, order, name, keys, weight).select(*df.columns, name)


def number_in_ranges(df: DataFrame, order, name: str, keys: list[str] | None = None,
                     weight: str | None = None) -> DataFrame:
    """``number_rows`` on a frame whose ``_range`` column already follows the
    order; without that column one task per key does it all."""
    keys = keys or []
    by = sort_columns(order)

    def place(window: Window) -> Column:
        if weight is None:
            return F.row_number().over(window.orderBy(*by))
        return F.sum(weight).over(window.orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))

    if "_range" not in df.columns:
        window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        return df.withColumn(name, place(window).cast("long"))
    local = df.withColumn("_pos", place(Window.partitionBy(*keys, "_range")))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    many = F.count(F.lit(1)) if weight is None else F.sum(weight)
    offsets = df.groupBy(*keys, "_range").agg(many.alias("_many_in")).withColumn(
        "_before", F.coalesce(F.sum("_many_in").over(earlier), F.lit(0))).drop("_many_in")
    return local.join(offsets, [*keys, "_range"]).withColumn(
        name, (F.col("_pos") + F.col("_before")).cast("long")).select(*df.columns, name)


def running_depth(df: DataFrame, key: str, order, step: str) -> DataFrame:
    """Per ``key``, the running sum of ``step`` that never falls below zero,
    before and after each row (``depth_before``, ``depth``).  With a ``_range``
    column that follows the order, ranges are summed apart and then joined with
    their offsets."""
    by = sort_columns(order)
    zero = F.lit(0)
    split = "_range" in df.columns
    groups = [key, "_range"] if split else [key]
    part = Window.partitionBy(*groups).orderBy(*by)
    to_here = part.rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn("_s", F.sum(step).over(to_here)).withColumn("_m", F.min("_s").over(to_here))
    local = local.withColumn("_m_before", F.lag("_m").over(part))
    if split:
        totals = df.groupBy(*groups).agg(F.sum(step).alias("_t")).join(
            local.groupBy(*groups).agg(F.min("_s").alias("_low")), groups)
        earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.withColumn("_base", F.coalesce(F.sum("_t").over(earlier), zero))
        totals = totals.withColumn("_floor", F.coalesce(F.min(F.col("_base") + F.col("_low")).over(earlier), zero))
        local = local.join(totals.select(*groups, "_base", "_floor"), groups)
    else:
        local = local.withColumn("_base", zero).withColumn("_floor", zero)
    total = F.col("_base") + F.col("_s")
    low = F.least(zero, F.col("_floor"), F.col("_base") + F.col("_m"))
    low_before = F.least(zero, F.col("_floor"), F.coalesce(F.col("_base") + F.col("_m_before"), zero))
    return local.withColumn("depth", (total - low).cast("long")).withColumn(
        "depth_before", (total - F.col(step) - low_before).cast("long")).select(*df.columns, "depth_before", "depth")


def first_of_key(df: DataFrame, keys: list[str], order) -> DataFrame:
    """The first row of every key in ``order``; nulls come first in ascending and
    last in descending columns, rows equal in ``order`` follow their other columns.

    Two steps: the best first value of a key is a hash aggregate on two or few
    narrow columns, combined before the shuffle.  Only the rows that have it are
    joined back, spread by key and value, so a hot key is no hot task; the other
    columns decide among them, again cut down before the shuffle.  ``df`` is read
    twice, the first time without its other columns."""
    if not df.columns[len(keys):]:
        return df.distinct()
    spec = normalise(order)
    lead, direction = spec[0]
    best = F.max(lead) if direction == "desc" else F.when(F.count_if(F.col(lead).isNull()) == 0, F.min(lead))
    found = df.groupBy(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]).agg(best.alias("__lead"))
    same = F.col(lead).eqNullSafe(F.col("__lead"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__key{i}"))
    named = [c for c, _ in spec]
    by = sort_columns(spec) + [F.col(c).desc() for c in df.columns if c not in named and c not in keys
           and not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    return df.join(found, same).withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(
        "__place = 1").select(*df.columns)
