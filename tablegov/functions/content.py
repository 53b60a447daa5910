"""Chat content, markup, definitions and database types as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- chat ---------------------------------------------------------------------

# Title of a session without one, roles that count as messages.
DEFAULT_TITLE = "未命名会话"
MESSAGE_ROLES = ["user", "assistant"]


def title_of(name: Column, session_id: Column) -> Column:
    empty = F.lit("")
    return F.coalesce(F.nullif(name, empty), F.nullif(F.substring(session_id, 1, 8), empty), F.lit(DEFAULT_TITLE))


def messages_of(runs: Column) -> Column:
    """User and assistant messages of all runs in order.  ``runs`` is an array of
    structs with a ``messages`` array of structs with a ``role``."""
    spoken = F.transform(
        F.filter(runs, lambda r: r.isNotNull() & r["messages"].isNotNull()),
        lambda r: F.filter(r["messages"], lambda m: m.isNotNull() & m["role"].isin(MESSAGE_ROLES)))
    return F.flatten(spoken)


def extract_json_block(text: Column) -> Column:
    """The JSON text of a reply: all of it when it is an object, else the first
    fenced block; null when there is none or it does not parse."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    whole = trimmed.rlike(r"(?s)^\{.*\}$")
    fenced = F.regexp_extract(text, r"(?s)```json(.*?)```", 1)
    found = F.when(whole, trimmed).otherwise(F.nullif(F.regexp_replace(fenced, r"^\s+|\s+$", ""), F.lit("")))
    return F.when(F.try_parse_json(found).isNotNull(), found)


# Verbs that ask to go somewhere, page names, short keywords.
NAV_VERBS = ["跳转", "打开", "进入", "前往", "去", "浏览", "查看"]
NAV_PAGES = [("用户管理", "/system/user"), ("角色管理", "/system/role"), ("菜单管理", "/system/menu"),
             ("部门管理", "/system/dept"), ("字典管理", "/system/dict"), ("系统日志", "/system/log")]
NAV_KEYWORDS = [("用户", "/system/user"), ("角色", "/system/role"), ("菜单", "/system/menu"),
                ("部门", "/system/dept"), ("字典", "/system/dict"), ("日志", "/system/log")]


def nav_intent(text: Column, verbs=NAV_VERBS, pages=NAV_PAGES, keywords=NAV_KEYWORDS) -> Column:
    """Path the text asks for: a verb must occur, then page names are tried
    before short keywords, each list in order."""
    out = F.lit(None).cast("string")
    for word, path in reversed([*pages, *keywords]):
        out = F.when(F.contains(text, F.lit(word)), path).otherwise(out)
    asked = F.lit(False)
    for verb in verbs:
        asked = asked | F.contains(text, F.lit(verb))
    return F.when(asked, out)


# --- markup -------------------------------------------------------------------

def strip_tags(html: Column) -> Column:
    """Text without comments and tags.  Entities stay as they are."""
    return F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), r"<[^>]*>", "")


# --- task definitions ---------------------------------------------------------

def args_list(s: Column) -> Column:
    """Trimmed, non-empty parts of a comma list."""
    parts = F.transform(F.split(F.coalesce(s, F.lit("")), ","), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def kwargs_map(s: Column) -> Column:
    """JSON object as a map of text; unusable text gives an empty map."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(s, "map<string,string>"), empty)


def effective(node_value: Column, template_value: Column) -> Column:
    """A node's own setting wins over its template's."""
    return F.coalesce(node_value, template_value)


def interval_seconds(s: Column) -> Column:
    """"sec min hour day week" to seconds, ``*`` is 0; null unless there are five
    usable fields."""
    # Seconds per field.
    weights = [1, 60, 3600, 86400, 604800]
    parts = F.split(F.trim(s), r"\s+")
    total = F.lit(0).cast("long")
    for i, weight in enumerate(weights):
        part = F.get(parts, i)
        total = total + F.when(part == "*", F.lit(0)).otherwise(part.try_cast("long")) * weight
    return F.when(F.size(parts) == len(weights), total)


# --- database types -----------------------------------------------------------

def base_type(t: Column) -> Column:
    """Bare lower-case type name: collation, sign, length and modifiers are cut;
    ``tinyint(1)`` is a boolean, ``x[]`` and ``array[x]`` are arrays."""
    cut = F.regexp_replace(t, r"(?is)\s+collate\s.*$", "")
    cut = F.trim(F.regexp_replace(cut, r"(?i)\s+unsigned", ""))
    name = F.lower(F.regexp_extract(F.split_part(cut, F.lit("("), F.lit(1)), r"^\s*(\S*)", 1))
    return (
        F.when(F.lower(cut).startswith("tinyint(1)"), "boolean")
        .when(F.contains(cut, F.lit("[]")) | F.upper(cut).startswith("ARRAY["), "array")
        .otherwise(name)
    )


def type_length(t: Column) -> Column:
    """First number in the parentheses, 0 when there is none."""
    inner = F.regexp_extract(t, r"\(\s*([+-]?\d+)\s*(?:,[^)]*)?\)", 1)
    first = F.regexp_extract(t, r"^[^(]*\(([^)]*)\)", 1)
    usable = F.trim(F.split_part(first, F.lit(","), F.lit(1)))
    return F.coalesce(F.when(inner != "", usable.try_cast("int")), F.lit(0))


# Database type to Spark type.
TYPE_GROUPS = {
    "boolean": ["boolean", "bool"],
    "smallint": ["tinyint", "smallint", "int2"],
    "int": ["mediumint", "int", "integer", "int4", "year", "bit"],
    "bigint": ["bigint", "int8", "oid", "pg_lsn"],
    "double": ["real", "float", "double", "float8"],
    "decimal(38,18)": ["numeric", "decimal"],
    "decimal(19,2)": ["money"],
    "string": ["char", "varchar", "character", "citext", "tinytext", "text", "mediumtext", "longtext", "enum", "set",
               "uuid", "inet", "cidr", "macaddr", "xml", "tsvector", "tsquery", "regproc", "regclass", "regtype",
               "regrole", "regnamespace", "txid_snapshot", "pg_node_tree", "time", "timetz", "varbit"],
    "binary": ["bytea", "binary", "varbinary", "tinyblob", "blob", "mediumblob", "longblob", "geometry", "point",
               "linestring", "polygon", "multipoint", "multilinestring", "multipolygon", "geometrycollection", "line",
               "lseg", "box", "path", "circle"],
    "date": ["date"],
    "timestamp_ntz": ["timestamp", "datetime"],
    "timestamp": ["timestamptz"],
    "interval day to second": ["interval"],
    "variant": ["json", "jsonb", "composite"],
    "array<string>": ["array", "int2vector", "oidvector"],
    "struct<lower:string,upper:string,bounds:string>": ["range", "int4range", "int8range", "tsrange", "tstzrange",
                                                        "daterange"],
}


def map_type(t: Column, default: str = "string") -> Column:
    """Spark type of a database type; unknown names give ``default``."""
    pairs = [(name, spark) for spark, names in TYPE_GROUPS.items() for name in names]
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.coalesce(F.try_element_at(table, base_type(t)), F.lit(default))
