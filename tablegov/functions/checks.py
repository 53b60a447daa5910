"""Column quality predicates and row rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted shapes.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
MOBILE = r"^1(3\d|4[4-9]|5[0-35-9]|6[67]|7[013-8]|8[0-9]|9[0-9])\d{8}$"
PHONE = r"^1[3-9]\d{9}$"
CODE = r"^[A-Za-z][A-Za-z0-9_]{1,15}$"
GIT_URL = (r"^(?!(git\+ssh|ssh)://|git@)(?<scheme>git|https?|file)://(?<host>[^/]*)"
           r"(?<path>(?:/[^/]*)*/)(?<repo>[^/]+?)(?:\.git)?$")
IPV4 = r"^((25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$"
PRIVATE_IP = r"^(127\.|10\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.)"
PRIVATE_LABEL = "内网IP"
UNKNOWN_LABEL = "未解析(已关闭归属地查询)"


def _has(s: Column) -> Column:
    return F.coalesce(s, F.lit("")) != ""


def valid_email(s: Column) -> Column:
    return _has(s) & F.coalesce(s.rlike(EMAIL), F.lit(False))


def valid_mobile(s: Column) -> Column:
    """A missing number is fine."""
    return ~_has(s) | s.rlike(MOBILE)


def valid_code(s: Column, required: bool = False) -> Column:
    text = F.trim(s)
    return (_has(text) & text.rlike(CODE)) if required else (~_has(text) | text.rlike(CODE))


def re_search(s: Column, pattern: str) -> Column:
    """Pattern anywhere; an empty pattern or text never matches."""
    return F.coalesce(_has(s) & s.rlike(pattern), F.lit(False)) if pattern else F.lit(False)


def re_match(s: Column, pattern: str) -> Column:
    """Pattern from the start of the text."""
    return re_search(s, rf"\A(?:{pattern})") if pattern else F.lit(False)


def is_phone(s: Column) -> Column:
    return re_search(s, PHONE)


def is_git_url(s: Column) -> Column:
    return re_search(s, GIT_URL)


def valid_ip(s: Column) -> Column:
    return F.coalesce(s.rlike(IPV4), F.lit(False))


def is_private_ip(s: Column) -> Column:
    return F.coalesce(s.rlike(PRIVATE_IP), F.lit(False))


def location_label(ip: Column) -> Column:
    """Private addresses get their label, others stay unresolved: there is no
    outside lookup.  No address, no label."""
    return F.when(_has(ip), F.when(is_private_ip(ip), PRIVATE_LABEL).otherwise(UNKNOWN_LABEL))


# --- row rules ----------------------------------------------------------------

Rule = tuple[Column, str]


def demo_rules(name="name", status="status", description="description") -> list[Rule]:
    """Broken when true.  The name must be all letters and digits or all ``-_``."""
    text = F.trim(F.col(name))
    size = F.length(text)
    shape = text.rlike(r"^[\p{L}\p{N}]+$") | text.rlike(r"^[-_]+$")
    return [
        (~_has(text), "name_empty"),
        (_has(text) & ~size.between(2, 50), "name_length"),
        (_has(text) & ~shape, "name_characters"),
        (~F.coalesce(F.col(status).isin("0", "1"), F.lit(False)), "status"),
        (F.length(F.col(description)) > 255, "description_length"),
    ]


def menu_rules() -> list[Rule]:
    kind = F.col("type")
    page = kind.isin(1, 2)
    return [
        (~F.coalesce(kind.isin(1, 2, 3, 4), F.lit(False)), "type"),
        (page & ~_has(F.col("route_name")), "route_name"),
        (page & ~_has(F.col("route_path")), "route_path"),
        ((kind == 1) & ~_has(F.trim(F.col("redirect"))), "redirect"),
        ((kind == 2) & ~_has(F.col("component_path")), "component_path"),
        (~F.coalesce(F.nullif(F.col("client"), F.lit("")), F.lit("pc")).isin("pc", "app"), "client"),
    ]


def scope_rules(scope="data_scope") -> list[Rule]:
    return [(~F.coalesce(F.col(scope).between(1, 5), F.lit(False)), "data_scope")]


def row_errors(rules: list[Rule]) -> Column:
    """Names of all broken rules, in order."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for broken, name in rules]))


def split_valid(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Rows that break nothing, and the others with their ``errors``."""
    checked = df.withColumn("errors", row_errors(rules))
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)
