"""Scalar functions, sources and key-value snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegov.functions import checks as K
from tablegov.functions import content as C
from tablegov.functions import cron as R
from tablegov.functions import files as P
from tablegov.functions import text as X
from tablegov.plans.registry import query
from tablegov.session import ensure_checkpoint_dir
from tablegov.sources import io as A

# --- text ---------------------------------------------------------------------


@query("bytes_human", """SELECT id, CASE WHEN n >= 1073741824 THEN printf('%.1fGB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.1fMB', n / 1048576.0)
    WHEN n >= 1024 THEN printf('%.1fKB', n / 1024.0) ELSE printf('%.1fB', n * 1.0) END AS size
    FROM (SELECT o_orderkey AS id, CAST(floor(o_totalprice * CASE o_orderstatus WHEN 'F' THEN 10000 WHEN 'O' THEN 1 ELSE 0.001 END) AS BIGINT) AS n FROM orders)""")
def _(v):
    scale = F.when(F.col("o_orderstatus") == "F", 10000).when(F.col("o_orderstatus") == "O", 1).otherwise(0.001)
    return v.orders.select(F.col("o_orderkey").alias("id"),
                           X.bytes_human(F.floor(F.col("o_totalprice") * scale)).alias("size"))


@query("file_size", """SELECT path, CASE WHEN size = 0 THEN '0B' WHEN size >= 1048576 THEN printf('%.2fMB', floor(size / 1048576.0))
    WHEN size >= 1024 THEN printf('%.2fKB', floor(size / 1024.0)) ELSE printf('%.2fB', size * 1.0) END AS text
    FROM (SELECT path, CASE WHEN path LIKE '%PROMO%' THEN size * 100 WHEN path LIKE '%LARGE%' THEN 0 ELSE size END AS size FROM v_file)""")
def _(v):
    path, size = F.col("path"), F.col("size")
    size = F.when(path.like("%PROMO%"), size * 100).when(path.like("%LARGE%"), 0).otherwise(size)
    return v.file.select("path", X.file_size(size).alias("text"))


_SNAKE = "SELECT DISTINCT replace(replace(lower(p_brand || '_' || p_name || '_' || p_type), '#', '_'), ' ', '_') AS s FROM part"
_WORD = "[upper(w[1]) || lower(w[2:]) for w in {list}]"


def _snake(v):
    raw = F.lower(F.concat_ws("_", "p_brand", "p_name", "p_type"))
    return v.part.select(F.translate(raw, "# ", "__").alias("s")).distinct()


@query("case_pascal", f"SELECT s, array_to_string({_WORD.format(list='string_split(s, chr(95))')}, '') AS pascal FROM ({_SNAKE})")
def _(v):
    return _snake(v).select("s", X.to_pascal(F.col("s")).alias("pascal"))


@query("case_lower_camel", f"SELECT s, split_part(s, '_', 1) || array_to_string({_WORD.format(list='string_split(s, chr(95))[2:]')}, '') AS camel FROM ({_SNAKE})")
def _(v):
    return _snake(v).select("s", X.to_lower_camel(F.col("s")).alias("camel"))


@query("case_snake", f"""SELECT p, lower(regexp_replace(regexp_replace(p, '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake
    FROM (SELECT array_to_string({_WORD.format(list='string_split(s, chr(95))')}, '') AS p FROM ({_SNAKE}))""")
def _(v):
    return _snake(v).select(X.to_pascal(F.col("s")).alias("p")).select("p", X.to_snake(F.col("p")).alias("snake"))


@query("class_name", f"""SELECT p_partkey, CASE WHEN contains(n, '_') THEN array_to_string({_WORD.format(list="string_split(n, '_') if w <> ''")}, '')
    ELSE upper(n[1]) || n[2:] END AS class_name FROM (SELECT p_partkey, CASE WHEN p_size > 20 THEN replace('_' || p_name, ' ', '__') ELSE p_name || 'X' END AS n FROM part)""")
def _(v):
    name = F.when(F.col("p_size") > 20, F.regexp_replace(F.concat(F.lit("_"), "p_name"), " ", "__")).otherwise(
        F.concat("p_name", F.lit("X")))
    return v.part.select("p_partkey", X.class_name(name).alias("class_name"))


@query("blank_tests", """SELECT conv_id, turn, regexp_matches(s, '^ *$') AS blank, s = '' AS empty, s <> '' AS not_empty FROM
    (SELECT conv_id, turn, CASE role WHEN 'system' THEN '  ' WHEN 'assistant' THEN '' ELSE text END AS s FROM conversations)""")
def _(v):
    s = F.when(F.col("role") == "system", "  ").when(F.col("role") == "assistant", "").otherwise(F.col("text"))
    return v.conversations.select("conv_id", "turn", X.is_blank(s).alias("blank"), X.is_empty(s).alias("empty"),
                                  X.is_not_empty(s).alias("not_empty"))


@query("url_tests", """SELECT page_id, starts_with(url, 'http://') OR starts_with(url, 'https://') AS http,
    regexp_matches(rest, '^(https?:|mailto:|tel:)') AS external FROM (SELECT page_id, url, CASE WHEN url LIKE '%fr%' THEN url[8:] ELSE url END AS rest FROM pages)""")
def _(v):
    rest = F.when(F.col("url").like("%fr%"), F.expr("substring(url, 8)")).otherwise(F.col("url"))
    return v.pages.select("page_id", X.is_http(F.col("url")).alias("http"), X.is_external(rest).alias("external"))


@query("text_matches", """SELECT DISTINCT source, lang, lower(source) = 'src1' AS same, lower(source) IN ('src1', 'src2') AS same_any,
    starts_with(source, 'src1') OR starts_with(source, 'src3') AS starts FROM documents""")
def _(v):
    s = F.col("source")
    return v.documents.select("source", "lang").distinct().select(
        "source", "lang", X.equals_ci(s, "SRC1").alias("same"), X.equals_any_ci(s, ["Src1", "SRC2"]).alias("same_any"),
        X.starts_any(s, ["src1", "src3"]).alias("starts"))


@query("map_ci", "SELECT event_id, CASE event_type WHEN 'view' THEN 'see' WHEN 'click' THEN 'tap' ELSE '' END AS label FROM events")
def _(v):
    return v.events.select("event_id", X.map_ci({"VIEW": "see", "Click": "tap", "view": "no"}, F.col("event_type")).alias("label"))


# --- time ---------------------------------------------------------------------

@query("fmt_ts", """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, strftime(ts, '%Y-%m-%d %H:%M') AS minute,
    strftime(ts, '%Y-%m-%d') AS day FROM events""")
def _(v):
    return v.events.select("event_id", X.fmt_ts(F.col("ts")).alias("ts"), X.minute_fmt(F.col("ts")).alias("minute"),
                           F.date_format("ts", X.DATE_FORMAT).alias("day"))


@query("format_times", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at, strftime(o_orderdate, '%Y-%m-%d') AS day,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS nested FROM orders""")
def _(v):
    at = F.col("o_orderdate")
    rows = v.orders.select("o_orderkey", at.alias("at"), at.cast("date").alias("day"),
                           F.array(F.struct(at.alias("t"))).alias("nested"))
    return X.format_times(rows).withColumn("nested", F.col("nested")[0]["t"])


_TIMES = """SELECT event_id, CASE event_type WHEN 'view' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 'click' THEN strftime(ts, '%Y/%m/%d')
    WHEN 'error' THEN '2024-13-45 10:00:00' ELSE strftime(ts, '%Y-%m-%d') END AS s, strftime(ts, '%H:%M:%S') AS t FROM events"""


@query("parse_times", f"""SELECT event_id, strftime(try_strptime(s, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS ts,
    CASE WHEN length(s) = 10 THEN strftime(try_strptime(s, '%Y-%m-%d'), '%Y-%m-%d') END AS day, t AS time FROM ({_TIMES})""")
def _(v):
    kind, ts = F.col("event_type"), F.col("ts")
    s = (F.when(kind == "view", X.fmt_ts(ts)).when(kind == "click", F.date_format(ts, "yyyy/MM/dd"))
         .when(kind == "error", "2024-13-45 10:00:00").otherwise(F.date_format(ts, "yyyy-MM-dd")))
    rows = v.events.select("event_id", s.alias("s"), F.date_format(ts, "HH:mm:ss").alias("t"))
    return rows.select("event_id", X.fmt_ts(X.parse_ts(F.col("s"))).alias("ts"),
                       F.date_format(X.parse_date(F.col("s")), X.DATE_FORMAT).alias("day"),
                       X.parse_time(F.col("t")).alias("time"))


@query("parse_rejects", f"SELECT event_id, s FROM ({_TIMES}) WHERE try_strptime(s, '%Y-%m-%d %H:%M:%S') IS NULL")
def _(v):
    kind, ts = F.col("event_type"), F.col("ts")
    s = (F.when(kind == "view", X.fmt_ts(ts)).when(kind == "click", F.date_format(ts, "yyyy/MM/dd"))
         .when(kind == "error", "2024-13-45 10:00:00").otherwise(F.date_format(ts, "yyyy-MM-dd")))
    return X.parse_rejects(v.events.select("event_id", s.alias("s")), "s", X.parse_ts(F.col("s")))


@query("unix_to_ts", "SELECT event_id, strftime(to_timestamp(1700000000 + event_id * 977)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def _(v):
    return v.events.select("event_id", X.unix_to_ts(F.lit(1700000000) + F.col("event_id") * 977).alias("at"))


# --- requests -----------------------------------------------------------------

@query("client_ip", "SELECT id, CASE WHEN coalesce(forwarded, '') <> '' THEN trim(split_part(forwarded, ',', 1)) ELSE peer END AS ip FROM v_log")
def _(v):
    return v.log.select("id", X.client_ip(F.col("forwarded"), F.col("peer")).alias("ip"))


@query("location_label", """SELECT DISTINCT peer, CASE WHEN regexp_matches(peer, '^(127\\.|10\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|192\\.168\\.)') THEN '内网IP'
    ELSE '未解析(已关闭归属地查询)' END AS location FROM v_log""")
def _(v):
    return v.log.select("peer").distinct().select("peer", K.location_label(F.col("peer")).alias("location"))


@query("process_seconds", "SELECT id, latency AS seconds FROM v_log")
def _(v):
    return v.log.select("id", X.process_seconds(F.col("process_time")).alias("seconds"))


@query("handler_label", "SELECT id, CAST(code // 100 AS VARCHAR) || 'xx' AS status FROM v_log")
def _(v):
    return v.log.select("id", X.handler_label(F.col("code")).alias("status"))


@query("growth_text", """SELECT event_id, CASE WHEN r = 0 THEN '-' ELSE regexp_replace(printf('%.2f', round(abs(r * 100) * 100) / 100), '\\.?0+$', '') || '%' END AS growth
    FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 0 ELSE event_id / 64.0 - 40 END AS r FROM events)""")
def _(v):
    r = F.when(F.col("event_type") == "view", 0).otherwise(F.col("event_id") / 64.0 - 40)
    return v.events.select("event_id", X.growth_text(r).alias("growth"))


@query("weak_password", """SELECT p_partkey, CASE WHEN length(s) < 6 THEN 'length' WHEN NOT regexp_matches(s, '[A-Z]') THEN 'upper'
    WHEN NOT regexp_matches(s, '[a-z]') THEN 'lower' WHEN NOT regexp_matches(s, '[0-9]') THEN 'digit' END AS reason
    FROM (SELECT p_partkey, CASE WHEN p_size > 40 THEN p_type WHEN p_size > 30 THEN p_brand WHEN p_size > 20 THEN p_name || p_size
        WHEN p_size > 10 THEN p_type || lower(p_brand) ELSE p_name || p_type END AS s FROM part)""")
def _(v):
    size = F.col("p_size")
    s = (F.when(size > 40, F.col("p_type")).when(size > 30, F.col("p_brand"))
         .when(size > 20, F.concat("p_name", size.cast("string"))).when(size > 10, F.concat("p_type", F.lower("p_brand")))
         .otherwise(F.concat("p_name", "p_type")))
    return v.part.select("p_partkey", X.weak_password(s).alias("reason"))


@query("uuid_col", None)
def _(v):
    return v.events.select("event_id", X.uuid_col().alias("uuid"))


# --- chat ---------------------------------------------------------------------

@query("title_of", """SELECT conv_id, turn, coalesce(CASE WHEN role = 'system' THEN nullif(text, '') END,
    nullif((lpad(CAST(conv_id AS VARCHAR), 12, 'x'))[1:8], ''), '未命名会话') AS title FROM conversations""")
def _(v):
    name = F.when(F.col("role") == "system", F.col("text")).otherwise("")
    return v.conversations.select("conv_id", "turn", C.title_of(
        name, F.lpad(F.col("conv_id").cast("string"), 12, "x")).alias("title"))


@query("messages_of", "SELECT conv_id, turn, role, length(text) AS size FROM conversations WHERE role IN ('user', 'assistant')")
def _(v):
    # Every turn as a session of one run, so that no array grows with a conversation.
    message = F.struct("role", F.col("text").alias("content"), "turn")
    runs = F.array(F.struct(F.array(message, F.lit(None).cast("struct<role:string,content:string,turn:bigint>")).alias("messages")),
                   F.lit(None).cast("struct<messages:array<struct<role:string,content:string,turn:bigint>>>"))
    rows = v.conversations.select("conv_id", runs.alias("runs"))
    return rows.select("conv_id", F.inline(C.messages_of(F.col("runs")))).select(
        "conv_id", "turn", "role", F.length("content").alias("size"))


_REPLY = """SELECT event_id, CASE event_type WHEN 'view' THEN ' ' || props || ' ' WHEN 'click' THEN 'Here: ```json ' || props || ' ``` done'
    WHEN 'error' THEN '{broken' || props WHEN 'signup' THEN '```json ``` ' ELSE 'no json' END AS s FROM events"""


@query("extract_json_block", f"""SELECT event_id, CASE WHEN json_valid(f) THEN f END AS block FROM (SELECT event_id, CASE WHEN starts_with(trim(s), '{{') AND ends_with(trim(s), '}}')
    THEN trim(s) ELSE nullif(trim(regexp_extract(s, '```json(.*?)```', 1)), '') END AS f FROM ({_REPLY}))""")
def _(v):
    kind, props = F.col("event_type"), F.col("props")
    s = (F.when(kind == "view", F.concat(F.lit(" "), props, F.lit(" ")))
         .when(kind == "click", F.concat(F.lit("Here: ```json "), props, F.lit(" ``` done")))
         .when(kind == "error", F.concat(F.lit("{broken"), props)).when(kind == "signup", "```json ``` ").otherwise("no json"))
    return v.events.select("event_id", C.extract_json_block(s).alias("block"))


@query("nav_intent", """SELECT id, CASE WHEN contains(s, '打开') OR contains(s, '去') THEN
    CASE WHEN contains(s, '用户管理') THEN '/system/user' WHEN contains(s, '系统日志') THEN '/system/log'
        WHEN contains(s, '角色') THEN '/system/role' WHEN contains(s, '日志') THEN '/system/log' END END AS path
    FROM (SELECT p_partkey AS id, CASE p_type WHEN 'PROMO' THEN '打开' WHEN 'SMALL' THEN '去' ELSE '看' END ||
        CASE WHEN p_size > 40 THEN '角色和用户管理' WHEN p_size > 30 THEN '日志' WHEN p_size > 20 THEN '系统日志角色' WHEN p_size > 10 THEN '角色' ELSE p_name END AS s FROM part)""")
def _(v):
    size, kind = F.col("p_size"), F.col("p_type")
    verb = F.when(kind == "PROMO", "打开").when(kind == "SMALL", "去").otherwise("看")
    what = (F.when(size > 40, "角色和用户管理").when(size > 30, "日志").when(size > 20, "系统日志角色")
            .when(size > 10, "角色").otherwise(F.col("p_name")))
    return v.part.select(F.col("p_partkey").alias("id"), C.nav_intent(F.concat(verb, what)).alias("path"))


@query("nav_intent_documents", """SELECT doc_id, CASE WHEN contains(text, 'the') OR contains(text, 'que') THEN
    CASE WHEN contains(text, 'shthat') THEN '/a' WHEN contains(text, 'eaux') THEN '/b' WHEN contains(text, 'and') THEN '/c' END END AS path FROM documents""")
def _(v):
    return v.documents.select("doc_id", C.nav_intent(
        F.col("text"), ["the", "que"], [("shthat", "/a"), ("eaux", "/b")], [("and", "/c")]).alias("path"))


@query("strip_tags", "SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<[^>]*>', '', 'g') AS text FROM pages")
def _(v):
    return v.pages.select("page_id", C.strip_tags(F.col("html")).alias("text"))


# --- definitions --------------------------------------------------------------

@query("args_list", """SELECT p_partkey, array_to_string([trim(x) for x in string_split(s, ',') if trim(x) <> ''], '|') AS args
    FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN ' ' || replace(p_name, ' ', ' ,, ') || ', ' ELSE p_type END AS s FROM part)""")
def _(v):
    s = F.when(F.col("p_size") > 25, F.concat(F.lit(" "), F.regexp_replace("p_name", " ", " ,, "), F.lit(", "))).otherwise(F.col("p_type"))
    return v.part.select("p_partkey", F.array_join(C.args_list(s), "|").alias("args"))


@query("kwargs_map", """SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN '5' ELSE json_extract_string(props, '$.k') END AS k FROM events""")
def _(v):
    own = F.when(F.col("event_type") == "error", "{bad").when(F.col("event_type") != "view", F.col("props"))
    parsed = C.kwargs_map(C.effective(own, F.lit('{"k": 5}')))
    return v.events.select("event_id", F.try_element_at(parsed, F.lit("k")).alias("k"))


@query("valid_cron", """WITH t AS (SELECT p_partkey, p_size AS n, p_type AS k FROM part),
    c AS (SELECT *, CASE k WHEN 'PROMO' THEN '0 ' || n || ' 8-' || n || ' * * ?' WHEN 'SMALL' THEN '0/' || n || ' 5,' || n || ' 0 1W 1/' || n || ' 2#3'
        WHEN 'LARGE' THEN '0 0 ' || n || ' L * ?' WHEN 'MEDIUM' THEN '0 0 0 ' || n || ' ' || n || ' ? ' || (2000 + n) WHEN 'STANDARD' THEN '* * * * *'
        ELSE '0 0 0 ? ' || n || ' ' || n END AS cron FROM t)
    SELECT p_partkey, cron, CASE k WHEN 'PROMO' THEN n <= 59 AND 8 < n AND n <= 23 WHEN 'SMALL' THEN n BETWEEN 1 AND 59 AND n BETWEEN 1 AND 11
        WHEN 'LARGE' THEN n <= 23 WHEN 'MEDIUM' THEN n BETWEEN 0 AND 31 AND n BETWEEN 0 AND 12 AND 2000 + n BETWEEN 2007 AND 2015
        WHEN 'STANDARD' THEN false ELSE n BETWEEN 0 AND 12 AND n BETWEEN 1 AND 7 END AS valid FROM c""")
def _(v):
    n, k = F.col("p_size").cast("string"), F.col("p_type")

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    cron = (F.when(k == "PROMO", text("0 ", n, " 8-", n, " * * ?"))
            .when(k == "SMALL", text("0/", n, " 5,", n, " 0 1W 1/", n, " 2#3"))
            .when(k == "LARGE", text("0 0 ", n, " L * ?"))
            .when(k == "MEDIUM", text("0 0 0 ", n, " ", n, " ? ", (F.col("p_size") + 2000).cast("string")))
            .when(k == "STANDARD", "* * * * *").otherwise(text("0 0 0 ? ", n, " ", n)))
    rows = v.part.select("p_partkey", cron.alias("cron"))
    return rows.select("p_partkey", "cron", R.valid_cron(F.col("cron"), 2007).alias("valid"))


@query("interval_seconds", """SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN NULL ELSE CAST(p_size + 60 * 5 + 86400 * (p_size // 10) AS BIGINT) END AS seconds FROM part""")
def _(v):
    size = F.col("p_size")
    s = F.when(F.col("p_type") == "PROMO", F.concat(size.cast("string"), F.lit(" 5"))).otherwise(
        F.concat_ws(" ", size.cast("string"), F.lit("5  *"), F.floor(size / 10).cast("string"), F.lit("*")))
    return v.part.select("p_partkey", C.interval_seconds(s).alias("seconds"))


_TYPE = """SELECT p_partkey, CASE WHEN p_size > 45 THEN 'tinyint(1)' WHEN p_size > 40 THEN 'INT(' || p_size || ') unsigned' WHEN p_size > 30 THEN 'varchar(' || p_size || ') COLLATE utf8'
    WHEN p_size > 25 THEN 'Timestamp without time zone' WHEN p_size > 20 THEN 'integer[]' WHEN p_size > 15 THEN 'decimal(' || p_size || ', 2)' ELSE lower(p_type) || '(x)' END AS t, p_size FROM part"""
_BASE = """CASE WHEN p_size > 45 THEN 'boolean' WHEN p_size > 40 THEN 'int' WHEN p_size > 30 THEN 'varchar' WHEN p_size > 25 THEN 'timestamp'
    WHEN p_size > 20 THEN 'array' WHEN p_size > 15 THEN 'decimal' ELSE split_part(t, '(', 1) END"""


@query("database_types", f"""SELECT p_partkey, {_BASE} AS base, CASE WHEN p_size > 45 THEN 1 WHEN p_size > 30 OR p_size BETWEEN 16 AND 20 THEN p_size ELSE 0 END AS length,
    CASE {_BASE} WHEN 'boolean' THEN 'boolean' WHEN 'int' THEN 'int' WHEN 'timestamp' THEN 'timestamp_ntz' WHEN 'array' THEN 'array<string>'
        WHEN 'decimal' THEN 'decimal(38,18)' ELSE 'string' END AS spark FROM ({_TYPE})""")
def _(v):
    size = F.col("p_size")
    text = size.cast("string")
    t = (F.when(size > 45, "tinyint(1)").when(size > 40, F.concat(F.lit("INT("), text, F.lit(") unsigned")))
         .when(size > 30, F.concat(F.lit("varchar("), text, F.lit(") COLLATE utf8")))
         .when(size > 25, "Timestamp without time zone").when(size > 20, "integer[]")
         .when(size > 15, F.concat(F.lit("decimal("), text, F.lit(", 2)"))).otherwise(F.concat(F.lower("p_type"), F.lit("(x)"))))
    rows = v.part.select("p_partkey", t.alias("t"))
    return rows.select("p_partkey", C.base_type(F.col("t")).alias("base"), C.type_length(F.col("t")).alias("length"),
                       C.map_type(F.col("t")).alias("spark"))


# --- files --------------------------------------------------------------------

@query("safe_name", """SELECT p_partkey, CASE WHEN p_size > 40 THEN 'file_x' WHEN p_size > 30 THEN 'file_x' WHEN p_size > 20 THEN p_name
    WHEN p_size > 10 THEN p_name || p_size || '.txt' ELSE 'file_x' END AS name FROM part""")
def _(v):
    size, name = F.col("p_size"), F.col("p_name")
    raw = (F.when(size > 40, F.concat(name, F.lit("/../x"))).when(size > 30, F.concat(name, F.lit("%252e%252e")))
           .when(size > 20, F.concat(F.lit(" ."), name, F.lit(" . "))).when(size > 10, F.concat(name, F.lit("<"), size.cast("string"), F.lit("|.txt")))
           .otherwise(F.lit("?")))
    return v.part.select("p_partkey", P.safe_name(raw, F.lit("file_x")).alias("name"))


@query("path_parts", """SELECT path, length(path) - length(replace(path, '/', '')) AS depth, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent,
    '.dat' AS extension, starts_with(split_part(path, '/', 3), '.') AS hidden FROM v_file""")
def _(v):
    p = F.col("path")
    return v.file.select("path", P.path_depth(p).alias("depth"), P.path_parent(p).alias("parent"),
                         P.path_extension(p).alias("extension"), P.path_hidden(p).alias("hidden"))


@query("file_kind", """SELECT page_id, CASE WHEN url LIKE '%/fr/%' THEN 'application/pdf' WHEN contains(html, 'https') THEN
    'image/gif' END AS kind FROM pages""")
def _(v):
    head = F.when(F.col("url").like("%/fr/%"), F.concat(F.lit("%PDF"), "html")).when(
        F.contains("html", F.lit("https")), F.concat(F.lit("GIF89a"), "html")).otherwise(F.col("html"))
    return v.pages.select("page_id", P.file_kind(F.encode(head, "UTF-8")).alias("kind"))


# --- sources ------------------------------------------------------------------

_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
           "conversations").split()


@query("scan_files", " UNION ALL ".join(
    f"SELECT '{t}' AS name, count(*) AS n_rows, false AS hidden, true AS has_size FROM {t}" for t in _TABLES))
def _(v):
    """Every file that is found, with its rows: without a column to read, files of any schema are one table."""
    files = A.scan_files(v.spark, v.dir, name_like=".parquet").select(
        _plain_path(F.col("path")).alias("path"), F.regexp_extract("path", r"(\w+)\.parquet", 1).alias("name"), "size", "is_hidden")
    rows = v.spark.read.schema(T.StructType()).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(v.dir)
    counted = rows.select(_plain_path(F.col("_metadata.file_path")).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return files.join(counted, "path", "left").groupBy("name").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.max("is_hidden").alias("hidden"), (F.sum("size") > 0).alias("has_size"))


def _plain_path(path):
    """One form for the two ways Spark writes a file's place."""
    return F.regexp_replace(path, "^([a-z]+):/+", "$1:/")


@query("apply_headers", "SELECT p_name AS name, p_type AS status FROM part")
def _(v):
    sheet = v.part.withColumnsRenamed({"p_name": "名称", "p_type": "状态"})
    return A.apply_headers(sheet, {"名称": "name", "状态": "status"})


_SHEET = """SELECT row_number() OVER (ORDER BY o_orderkey) AS row_no, o_orderkey AS k, o_orderstatus AS s, CAST(o_orderdate AS DATE) AS d,
    CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS a FROM orders"""
_BROKEN = "(k % 11 = 0 OR k % 13 = 0)"


def _upload(v):
    """Orders as an uploaded CSV with broken lines: wrong amounts and dates, no status, a value too many, a value short."""
    ensure_checkpoint_dir(v.spark)
    path = f"{v.spark.sparkContext.getCheckpointDir()}/upload-{uuid.uuid4().hex}"
    k = F.col("o_orderkey")
    amount = F.when(k % 5 == 0, "n/a").otherwise(F.col("o_totalprice").cast("decimal(15,2)").cast("string"))
    day = F.when(k % 7 == 0, "2024-13-45").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    status = F.when(k % 3 == 0, "").otherwise(F.col("o_orderstatus"))
    line = F.when(k % 11 == 0, F.concat_ws(",", k, day)).otherwise(F.concat_ws(
        ",", k, day, amount, status, F.when(k % 13 == 0, "more")))
    # One column between tabs, so that no comma is quoted.
    v.orders.orderBy("o_orderkey").select(line.alias("编号,日期,金额,状态")).write.options(header=True, sep="\t").csv(path)
    return A.read_checked(v.spark, path, {"编号": ("id", "bigint"), "日期": ("day", "date"), "金额": ("amount", "decimal(15,2)"),
                                          "状态": ("status", "string")}, ("id", "status"))


@query("import_checked", f"""SELECT row_no, k AS id, strftime(d, '%Y-%m-%d') AS day, CAST(a AS DOUBLE) AS amount, s AS status FROM ({_SHEET})
    WHERE NOT {_BROKEN} AND k % 5 <> 0 AND k % 7 <> 0 AND k % 3 <> 0""")
def _(v):
    return _upload(v)[0].select("row_no", "id", F.col("day").cast("string").alias("day"), F.col("amount").cast("double").alias(
        "amount"), "status")


@query("import_rejects", f"""WITH t AS (SELECT row_no, k, CASE WHEN k % 5 = 0 THEN 'n/a' ELSE a END AS a, CASE WHEN k % 3 = 0 THEN '' ELSE s END AS s,
        CASE WHEN k % 7 = 0 THEN '2024-13-45' ELSE strftime(d, '%Y-%m-%d') END AS d FROM ({_SHEET}))
    SELECT row_no, NULL AS field, CASE WHEN k % 11 = 0 THEN k || ',' || d WHEN k % 13 = 0 THEN k || ',' || d || ',' || a || ',' || s || ',more' END AS value,
        'columns' AS reason FROM t WHERE {_BROKEN}
    UNION ALL SELECT row_no, 'amount', a, 'type' FROM t WHERE a = 'n/a' AND NOT {_BROKEN}
    UNION ALL SELECT row_no, 'day', d, 'type' FROM t WHERE k % 7 = 0 AND NOT {_BROKEN}
    UNION ALL SELECT row_no, 'status', NULL, 'required' FROM t WHERE s = '' AND NOT {_BROKEN}""")
def _(v):
    return _upload(v)[1]


@query("export_columns", "SELECT o_orderkey AS \"编号\", o_orderstatus AS \"状态\" FROM orders")
def _(v):
    return A.export_columns(v.orders, {"o_orderkey": "编号", "o_orderstatus": "状态"})


@query("export_rows", "SELECT id, amount FROM v_order WHERE status = 'O' AND amount > 200000")
def _(v):
    return A.export_rows(v.order, "remote", {"status": "O", "amount": (">", 200000)}).select("id", "amount")


@query("serialize_columns", """SELECT CAST(row_number() OVER (ORDER BY amount DESC, id) AS BIGINT) AS "No", CAST(id AS VARCHAR) AS "Order",
    CASE status WHEN 'F' THEN 'finished' ELSE 'open' END AS "State" FROM v_order""")
def _(v):
    state = F.when(F.col("status") == "F", "finished").otherwise("open")
    return A.serialize_columns(v.order, {"id": ("Order", None), "status": ("State", state)},
                               [("amount", "desc"), ("id", "asc")], "No")


@query("flatten_children", """SELECT p_brand || '-' || p_partkey AS id, CAST(NULL AS VARCHAR) AS parent_id FROM part UNION ALL
    SELECT p_name || '-' || p_partkey, p_brand || '-' || p_partkey FROM part UNION ALL
    SELECT p_type || '-' || p_partkey, p_name || '-' || p_partkey FROM part WHERE p_size > 20""")
def _(v):
    def named(col):
        return F.concat_ws("-", col, F.col("p_partkey").cast("string")).alias("id")

    leaf = F.struct(named("p_type"))
    leaves = F.when(F.col("p_size") > 20, F.array(leaf)).otherwise(F.array().cast("array<struct<id:string>>"))
    rows = v.part.select(named("p_brand"), F.array(F.struct(named("p_name"), leaves.alias("children"))).alias("children"))
    return A.flatten_children(rows, "id").select("id", "parent_id")


_KV = """WITH c AS (SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) - 1 AS pos FROM part) """


def _snapshot(v, chunk):
    return A.snapshot_kv(v.part, "dict:1", ["p_brand"], ["p_partkey", "p_name"], ["p_size", "p_partkey"], chunk)


@query("snapshot_kv", _KV + """SELECT 'dict:1:' || p_brand AS key, pos // 50 AS chunk_no, '[' || string_agg('{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '"}', ',' ORDER BY pos) || ']' AS value_json
    FROM c GROUP BY 1, 2""")
def _(v):
    return _snapshot(v, 50).select("key", "chunk_no", "value_json")


@query("read_kv", _KV + """SELECT 'dict:1:' || p_brand AS key, p_partkey, p_name FROM c WHERE p_brand LIKE 'Brand#1_'""")
def _(v):
    entries = A.read_kv(_snapshot(v, 50), "array<struct<p_partkey:bigint,p_name:string>>", glob="dict:1:Brand[#]1?")
    return entries.select("key", F.inline("value"))


@query("date_spine", """SELECT strftime(d, '%Y-%m-%d') AS day, count(event_id) AS n FROM (SELECT unnest(generate_series(DATE '2023-12-30', DATE '2024-02-02', INTERVAL 1 DAY)) AS d)
    LEFT JOIN events ON CAST(ts AS DATE) = CAST(d AS DATE) GROUP BY 1""")
def _(v):
    days = v.events.groupBy(F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return A.fill_days(days, "day", ["n"], "2023-12-30", "2024-02-02").withColumn("day", F.date_format("day", "yyyy-MM-dd"))
