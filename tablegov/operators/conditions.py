"""Declarative search conditions: ``{column: value}`` or ``{column: (op, value)}``.

All conditions become plain Catalyst predicates on bare columns, so they reach
the file scan.  Calendar tests are written as half-open ranges because a
``date_format(col) = x`` predicate cannot be pushed down.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegov.session import sized

# Above this many values a membership test becomes a left-semi join, whose
# physical form Spark picks by size.
IN_LIST_LIMIT = 1000

_WORDS = {"eq": "==", "ne": "!=", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}


def _typed(df: DataFrame, name: str, value) -> Column:
    """A literal in the column's own type, so that the column stays uncast."""
    dtype = df.schema[name].dataType
    if dtype.typeName().startswith(("timestamp", "date")):
        return F.lit(str(value)).cast(dtype)
    return F.lit(value)


def _calendar(df: DataFrame, name: str, start: dt.date, end: dt.date) -> Column:
    col = F.col(name)
    return (col >= _typed(df, name, start)) & (col < _typed(df, name, end))


def same_day(df: DataFrame, name: str, day: str) -> Column:
    start = dt.date.fromisoformat(day)
    return _calendar(df, name, start, start + dt.timedelta(days=1))


def same_month(df: DataFrame, name: str, month: str) -> Column:
    start = dt.date.fromisoformat(month + "-01")
    end = (start + dt.timedelta(days=32)).replace(day=1)
    return _calendar(df, name, start, end)


def like_escaped(text: str) -> str:
    """Neutralise LIKE wildcards in ``text``."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def _compare(df: DataFrame, name: str, symbol: str, value) -> Column:
    col = F.col(name)
    if value is None:
        if symbol == "==":
            return col.isNull()
        return col.isNotNull() if symbol == "!=" else F.lit(False)
    lit = _typed(df, name, value)
    return {
        "==": col == lit, "!=": col != lit, ">": col > lit,
        ">=": col >= lit, "<": col < lit, "<=": col <= lit,
    }[symbol]


def condition(df: DataFrame, name: str, value, strict: bool = True) -> Column | None:
    """One condition, or ``None`` where the value means "no condition"."""
    if value is None or (isinstance(value, str) and value == ""):
        return None
    if name not in df.columns:
        raise ValueError(f"unknown column: {name}")
    if not isinstance(value, tuple):
        return _compare(df, name, "==", value)
    op, val = value
    col = F.col(name)
    if op == "None":
        return col.isNull()
    if op == "not None":
        return col.isNotNull()
    if op in ("date", "month", "like", "ilike", "literal"):
        if not val:
            return None
        if op == "date":
            return same_day(df, name, val)
        if op == "month":
            return same_month(df, name, val)
        if op == "literal":
            return col.like(f"%{like_escaped(val)}%")
        return col.like(f"%{val}%") if op == "like" else col.ilike(f"%{val}%")
    if op == "in":
        if val is None:
            return None
        values = list(val) if isinstance(val, (list, tuple, set, frozenset)) else [val]
        if not values:
            return F.lit(False)
        return col.isin([_typed(df, name, v) for v in values if v is not None])
    if op == "between":
        if not isinstance(val, (list, tuple)) or len(val) != 2:
            return None
        return col.between(_typed(df, name, val[0]), _typed(df, name, val[1]))
    if op in _WORDS:
        skip = (val is None or val == "") if strict else not val
        return None if skip else _compare(df, name, _WORDS[op], val)
    if op in _WORDS.values():
        return _compare(df, name, op, val)
    raise ValueError(f"unknown operator: {op}")


def _members(df: DataFrame, name: str, values) -> DataFrame:
    """The values as a one-column frame of the column's own type.  A fraction
    can equal no integer and is left out, as the literal form does."""
    dtype = df.schema[name].dataType
    known = {v for v in values if v is not None}
    if isinstance(dtype, T.IntegralType):
        known = {int(v) for v in known if isinstance(v, str) or (v == v and abs(v) != float("inf") and v == int(v))}
    rows = [(v,) if isinstance(v, str) and isinstance(dtype, T.StringType) else (str(v),) for v in known]
    return df.sparkSession.createDataFrame(rows, "v string").select(F.col("v").cast(dtype).alias(name))


def _is_long_list(value) -> bool:
    return (
        isinstance(value, tuple) and len(value) == 2 and value[0] == "in"
        and isinstance(value[1], (list, tuple, set, frozenset)) and len(value[1]) > IN_LIST_LIMIT
    )


def where(df: DataFrame, search: dict | None, strict: bool = True) -> DataFrame:
    """AND of all conditions.  ``strict=False`` lets the word operators skip
    every falsy value (0 and False too), not only None and ""."""
    conds, long_lists = [], {}
    for name, value in (search or {}).items():
        if _is_long_list(value) and name in df.columns:
            long_lists[name] = value[1]
            continue
        cond = condition(df, name, value, strict)
        if cond is not None:
            conds.append(cond)
    out = df.filter(reduce(lambda a, b: a & b, conds)) if conds else df
    for name, values in long_lists.items():
        out = out.join(sized(_members(df, name, values), len(values)), name, "left_semi").select(*df.columns)
    return out


# --- bundles -----------------------------------------------------------------

def base_search(description=None, status=None, created_time=None, updated_time=None) -> dict:
    """Filters every table shares; a time range needs exactly two ends."""
    search: dict = {}
    if description:
        search["description"] = ("like", description)
    if status:
        search["status"] = ("eq", status)
    for name, ends in (("created_time", created_time), ("updated_time", updated_time)):
        if ends and len(ends) == 2:
            search[name] = ("between", tuple(ends))
    return search


def by_user(created_id=None, updated_id=None, deleted_id=None) -> dict:
    given = {"created_id": created_id, "updated_id": updated_id, "deleted_id": deleted_id}
    return {name: ("eq", value) for name, value in given.items() if value}


_BASE_RANGES = {"created_time": "between", "updated_time": "between"}

# How each table's search form treats its columns.
PRESETS: dict[str, dict[str, str]] = {
    "user": {"username": "like", "name": "like", "mobile": "like", "email": "like",
             "dept_id": "eq", "tenant_id": "eq", "created_id": "eq", "updated_id": "eq",
             "status": "eq", **_BASE_RANGES},
    "dict_type": {"dict_name": "like", "dict_type": "eq", "status": "eq", **_BASE_RANGES},
    "dict_data": {"dict_label": "like", "dict_type": "eq", "dict_type_id": "eq",
                  "status": "eq", **_BASE_RANGES},
    "menu": {"name": "like", "route_path": "like", "component_path": "like",
             "permission": "like", "description": "like", "status": "eq",
             "created_id": "eq", "updated_id": "eq", "client": "eq", "type": "eq", **_BASE_RANGES},
    "log": {"request_path": "like", "request_method": "eq", "request_ip": "eq",
            "response_code": "eq", "type": "eq", "description": "like", "status": "eq",
            "created_id": "eq", "updated_id": "eq", **_BASE_RANGES},
    "job": {"job_id": "eq", "job_name": "like", "status": "eq", "trigger_type": "eq"},
    "ticket": {"title": "like", "ticket_type": "eq", "status": "eq", "created_id": "eq",
               "assigned_id": "eq"},
    "tenant": {"name": "like", "code": "like", "status": "eq", "created_time": "between"},
    "table": {"table_name": "like", "table_comment": "like"},
    "column": {"column_name": "like"},
    "role": {"name": "like", "description": "like", "status": "eq", **_BASE_RANGES},
    "notice": {"notice_title": "like", "notice_type": "eq", "description": "like", "status": "eq",
               "created_id": "eq", "updated_id": "eq", **_BASE_RANGES},
}


def preset(table: str, **values) -> dict:
    """Turn raw form values into a search for ``table``."""
    ops = PRESETS[table]
    unknown = sorted(set(values) - set(ops))
    if unknown:
        raise ValueError(f"{table} has no search field {unknown}")
    search = {}
    for name, value in values.items():
        if value is None or value == "":
            continue
        if ops[name] == "between" and len(value) != 2:
            continue
        search[name] = (ops[name], tuple(value) if ops[name] == "between" else value)
    return search


# --- text and name filters ----------------------------------------------------

def contains_ci(col: Column, text: str | None) -> Column:
    """Case-insensitive contains; an empty side never matches."""
    if not text:
        return F.lit(False)
    return F.coalesce((F.length(col) > 0) & F.contains(F.lower(col), F.lit(text.lower())), F.lit(False))


def contains_any_ci(col: Column, texts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [contains_ci(col, t) for t in texts], F.lit(False))


def session_search(df: DataFrame, name=None, ipaddr=None, location=None) -> DataFrame:
    """Online-session filter: name and location ignore case, the address does not."""
    out = df
    if name:
        out = out.filter(contains_ci(F.col("name"), name))
    if ipaddr:
        out = out.filter(F.contains(F.col("ipaddr"), F.lit(ipaddr)))
    if location:
        out = out.filter(contains_ci(F.col("login_location"), location))
    return out


def hidden_filter(df: DataFrame, path: str, recursive: bool = False) -> DataFrame:
    """Drop dot-names; with ``recursive`` a dot anywhere along the path hides it."""
    pattern = r"(^|/)\." if recursive else r"(^|/)\.[^/]*$"
    return df.filter(~F.col(path).rlike(pattern))


def not_deleted(df: DataFrame, column: str = "is_deleted") -> DataFrame:
    return df.filter(~F.col(column))


# --- request log --------------------------------------------------------------

# Methods that are recorded, handlers that are not.
AUDITED_METHODS = ["POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]
IGNORED_HANDLERS = ["get_captcha_for_login"]


def audit_filter(log: DataFrame, method="method", handler="handler", referer="referer") -> DataFrame:
    ref = F.coalesce(F.col(referer), F.lit(""))
    return log.filter(
        F.col(method).isin(AUDITED_METHODS)
        & ~F.coalesce(F.col(handler).isin(IGNORED_HANDLERS), F.lit(False))
        & ~(ref.endswith("docs") | ref.endswith("redoc"))
    )


def block_requests(log: DataFrame, black: DataFrame, white: DataFrame, paths: DataFrame,
                   demo: bool, ip="ip", method="method", path="path") -> DataFrame:
    """Adds ``block_reason`` (null when let through).  The three lists are
    one-column frames; Spark broadcasts them when they are small."""
    def flag(frame: DataFrame, key: str, name: str) -> DataFrame:
        return frame.select(F.col(frame.columns[0]).alias(key)).distinct().withColumn(name, F.lit(True))

    marked = log.join(flag(black, ip, "_black"), ip, "left")
    marked = marked.join(flag(white, ip, "_white"), ip, "left")
    marked = marked.join(flag(paths, path, "_path"), path, "left")
    reason = F.when(F.col("_black"), F.lit("ip_black_list"))
    if demo:
        reason = reason.when(
            (F.col(method) != "GET") & F.col("_white").isNull() & F.col("_path").isNull(),
            F.lit("demo_mode"),
        )
    return marked.withColumn("block_reason", reason).select(*log.columns, "block_reason")
