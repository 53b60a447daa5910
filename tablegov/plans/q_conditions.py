"""Search conditions, governance and projections."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegov.functions import checks as C
from tablegov.functions import text as X
from tablegov.operators import conditions as B
from tablegov.operators import scope as S
from tablegov.operators.page import page_frame
from tablegov.operators.quality import LABELS, label_codes, options, project_out, response_label
from tablegov.operators.relate import page_with_one
from tablegov.operators.tree import filter_keep_path
from tablegov.plans.registry import query
from tablegov.spec import Ctx, Role, TableSpec

ORDER = TableSpec("order")
SHARED = TableSpec("order", platform_shared=True)
USER = TableSpec("user", creator=None, dept="dept_id")

# A caller in department 7 (under 1002) of tenant 2.
SELF = Ctx(user_id=7, tenant_id=2, dept_id=7, roles=(Role(1, 1),))
DEPT = Ctx(user_id=7, tenant_id=2, dept_id=7, roles=(Role(1, 1), Role(2, 2)))
SUBTREE = Ctx(user_id=7, tenant_id=2, dept_id=1002, roles=(Role(1, 3),))
ALL = Ctx(user_id=7, tenant_id=2, dept_id=7, roles=(Role(1, 4), Role(2, 2)))
CUSTOM = Ctx(user_id=7, tenant_id=2, dept_id=7, roles=(Role(1, 5, (3, 12)), Role(2, 2)))

_SUBTREE_SQL = """sub AS (SELECT id FROM v_dept WHERE id = 1002 UNION ALL
    SELECT d.id FROM v_dept d JOIN sub ON d.parent_id = sub.id)"""


# --- slice 0: the governed page ------------------------------------------------

def page_orders(v):
    search = {"description": ("like", "H"), "amount": ("between", (1000, 400000)), "status": ("in", ["O", "F"])}
    rows = S.read_governed(v.torder, ORDER, SUBTREE, search, v.user, v.dept)
    items = page_with_one(page_frame(rows, 2, 20, [("updated_time", "desc")]), v.user, "created_id", "created_by")
    return items.select(
        "id", "created_id", F.col("created_by.name").alias("creator_name"), "status", "amount", "description",
        X.fmt_ts(F.col("updated_time")).alias("updated_time"), "total", "page_no", "page_size", "has_next")


query("page_orders", f"""WITH RECURSIVE {_SUBTREE_SQL},
    vis AS (SELECT o.* FROM v_torder o WHERE NOT is_deleted AND tenant_id = 2 AND description LIKE '%H%'
        AND amount BETWEEN 1000 AND 400000 AND status IN ('O', 'F')
        AND created_id IN (SELECT id FROM v_user WHERE dept_id IN (SELECT id FROM sub)))
    SELECT p.id, p.created_id, u.name AS creator_name, p.status, p.amount, p.description,
        strftime(p.updated_time, '%Y-%m-%d %H:%M:%S') AS updated_time, p.total, 2 AS page_no, 20 AS page_size,
        40 < p.total AS has_next
    FROM (SELECT *, (SELECT count(*) FROM vis) AS total FROM vis ORDER BY updated_time DESC, id LIMIT 20 OFFSET 20) p
    LEFT JOIN v_user u ON u.id = p.created_id""")(page_orders)


# --- conditions ---------------------------------------------------------------

_COLS = ["id", "status", "amount", "description"]
_SEL = "SELECT id, status, amount, description FROM v_order WHERE "

for _name, _search, _sql in [
    ("cond_where", {"status": "O", "description": "", "priority": None, "amount": (">", 1000)},
     "status = 'O' AND amount > 1000"),
    ("cond_null", {"description": ("None", None)}, "description IS NULL"),
    ("cond_not_null", {"description": ("not None", None)}, "description IS NOT NULL"),
    ("cond_date", {"created_time": ("date", "1998-03-05")}, "strftime(created_time, '%Y-%m-%d') = '1998-03-05'"),
    ("cond_month", {"created_time": ("month", "1999-12")}, "strftime(created_time, '%Y-%m') = '1999-12'"),
    ("cond_like", {"description": ("like", "-_IGH")}, "description LIKE '%-_IGH%'"),
    ("cond_ilike", {"description": ("ilike", "urgent")}, "description ILIKE '%urgent%'"),
    ("cond_in", {"status": ("in", ["O", "P"])}, "status IN ('O', 'P')"),
    ("cond_in_empty", {"status": ("in", [])}, "false"),
    ("cond_between", {"created_time": ("between", ("1997-01-01 00:00:00", "1997-06-30 00:00:00"))},
     "created_time BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30'"),
    ("cond_ne", {"description": ("!=", "2-HIGH order")}, "description <> '2-HIGH order'"),
    ("cond_gt", {"amount": ("gt", 400000)}, "amount > 400000"),
    ("cond_ge", {"amount": (">=", 250000)}, "amount >= 250000"),
    ("cond_lt", {"amount": ("lt", 5000)}, "amount < 5000"),
    ("cond_le", {"created_time": ("<=", "1995-12-31 00:00:00")}, "created_time <= TIMESTAMP '1995-12-31'"),
    ("cond_eq", {"created_id": ("eq", 0)}, "created_id = 0"),
]:
    query(_name, _SEL + _sql)(lambda v, s=_search: B.where(v.order, s).select(*_COLS))


@query("cond_falsy_skip", _SEL + "true")
def _(v):
    return B.where(v.order, {"created_id": ("eq", 0)}, strict=False).select(*_COLS)


@query("cond_in_long_list", _SEL + "created_id IN (SELECT i FROM range(0, 5000, 1) t(i))")
def _(v):
    return B.where(v.order, {"created_id": ("in", list(range(5000)))}).select(*_COLS)


@query("base_search", _SEL + "description LIKE '%order%' AND status = 'F' AND created_time BETWEEN "
       "TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31' AND created_id = 9")
def _(v):
    search = B.base_search("order", "F", ["1996-01-01", "1999-12-31"], ["1996-01-01"]) | B.by_user(created_id=9)
    return B.where(v.order, search).select(*_COLS)


@query("preset_log", "SELECT id, method, path, code FROM v_log WHERE path LIKE '%c%' AND method = 'GET' AND code = 200")
def _(v):
    log = v.log.select("id", "method", F.col("path").alias("request_path"), F.col("method").alias("request_method"),
                       F.col("code").alias("response_code"))
    search = B.preset("log", request_path="c", request_method="GET", response_code=200, description="")
    return B.where(log, search).select("id", "method", F.col("request_path").alias("path"),
                                       F.col("response_code").alias("code"))


@query("not_deleted", "SELECT id, status FROM v_order WHERE NOT is_deleted")
def _(v):
    return B.not_deleted(v.order).select("id", "status")


# --- tenants and scopes -------------------------------------------------------

@query("tenant_orders", "SELECT id, tenant_id FROM v_torder WHERE tenant_id = 2")
def _(v):
    return S.tenant_filter(v.torder, ORDER, SELF).select("id", "tenant_id")


@query("tenant_platform_shared", "SELECT id, tenant_id FROM v_torder WHERE tenant_id IN (1, 2)")
def _(v):
    return S.tenant_filter(v.torder, SHARED, SELF).select("id", "tenant_id")


_SCOPE = "SELECT id, created_id FROM v_order WHERE "


@query("scope_self", _SCOPE + "created_id = 7")
def _(v):
    return S.scope_self(v.order, ORDER, SELF).select("id", "created_id")


for _name, _ctx, _sql in [
    ("scope_rows_self", SELF, "created_id = 7"),
    ("scope_dept", DEPT, "created_id IN (SELECT id FROM v_user WHERE dept_id = 7)"),
    ("scope_all", ALL, "true"),
    ("scope_custom", CUSTOM, "created_id IN (SELECT id FROM v_user WHERE dept_id IN (3, 7, 12))"),
]:
    query(_name, _SCOPE + _sql)(
        lambda v, c=_ctx: S.scope_rows(v.order, ORDER, c, v.user, v.dept).select("id", "created_id"))


@query("scope_dept_children", f"WITH RECURSIVE {_SUBTREE_SQL} " + _SCOPE
       + "created_id IN (SELECT id FROM v_user WHERE dept_id IN (SELECT id FROM sub))")
def _(v):
    return S.scope_rows(v.order, ORDER, SUBTREE, v.user, v.dept).select("id", "created_id")


@query("scope_user_table", f"WITH RECURSIVE {_SUBTREE_SQL} SELECT id, dept_id FROM v_user "
       "WHERE dept_id IN (SELECT id FROM sub)")
def _(v):
    return S.scope_dept(v.user, SUBTREE, v.dept, "dept_id", own_fallback=False).select("id", "dept_id")


_ROLES = Ctx(user_id=7, tenant_id=2, dept_id=7, roles=(Role(2, 1), Role(5, 1)))


@query("scope_menu", "SELECT id, name FROM v_menu WHERE status = '0' AND id IN "
       "(SELECT menu_id FROM v_role_menu WHERE role_id IN (2, 5))")
def _(v):
    return S.scope_menu(v.menu, _ROLES, v.role_menu).select("id", "name")


@query("scope_role", "SELECT id, name FROM v_role WHERE id IN (2, 5)")
def _(v):
    return S.scope_role(v.role, _ROLES).select("id", "name")


_WANTED = ["Brand#3:large", "Brand#8:economy"]


@query("permission_users", """SELECT id, is_superuser FROM v_user WHERE is_superuser OR id IN (
    SELECT ur.user_id FROM v_user_role ur JOIN v_role r ON r.id = ur.role_id AND r.status = '0'
    JOIN v_role_menu rm ON rm.role_id = r.id JOIN v_menu m ON m.id = rm.menu_id AND m.status = '0'
    WHERE m.permission IN ('Brand#3:large', 'Brand#8:economy'))""")
def _(v):
    return S.has_permission(v.user, _WANTED, v.user_role, v.role, v.role_menu, v.menu).select("id", "is_superuser")


@query("distinct_grants", """SELECT DISTINCT rm.role_id, m.permission FROM v_role_menu rm
    JOIN v_role r ON r.id = rm.role_id AND r.status = '0' JOIN v_menu m ON m.id = rm.menu_id AND m.status = '0'""")
def _(v):
    holders = v.role.select(F.col("id").alias("user_id"), F.col("id").alias("role_id"))
    return S.grants(holders, v.role, v.role_menu, v.menu).withColumnRenamed("user_id", "role_id")


@query("user_grants", """SELECT DISTINCT rm.role_id, m.permission FROM v_role_menu rm
    JOIN v_role r ON r.id = rm.role_id AND r.status = '0' JOIN v_menu m ON m.id = rm.menu_id AND m.status = '0'
    WHERE rm.role_id = (SELECT max(id) FROM v_role WHERE status = '0')""")
def _(v):
    holders = v.role.select(F.col("id").alias("user_id"), F.col("id").alias("role_id"))
    one = v.role.filter("status = '0'").agg(F.max("id")).scalar()
    return S.grants(holders, v.role, v.role_menu, v.menu, one).withColumnRenamed("user_id", "role_id")


# --- text filters -------------------------------------------------------------

@query("cond_literal", "SELECT doc_id FROM documents WHERE contains(text, '%%% ')")
def _(v):
    return B.where(v.documents, {"text": ("literal", "%%% ")}).select("doc_id")


@query("contains_ci", "SELECT doc_id, lang FROM documents WHERE lower(text) LIKE '%the on%'")
def _(v):
    return v.documents.filter(B.contains_ci(F.col("text"), "THE On")).select("doc_id", "lang")


@query("contains_any_ci", "SELECT doc_id FROM documents WHERE lower(text) LIKE '%eau%' OR lower(text) LIKE '%nicht%'")
def _(v):
    return v.documents.filter(B.contains_any_ci(F.col("text"), ["EAU", "Nicht"])).select("doc_id")


@query("session_search", "SELECT id, name FROM v_user WHERE lower(name) LIKE '%r#00000001%'")
def _(v):
    rows = v.user.withColumn("ipaddr", F.lit("10.0.0.1")).withColumn("login_location", F.col("segment"))
    return B.session_search(rows, name="R#00000001", ipaddr="10.0", location=None).select("id", "name")


@query("hidden_filter", "SELECT path FROM v_file WHERE NOT starts_with(split_part(path, '/', 3), '.')")
def _(v):
    return B.hidden_filter(v.file, "path").select("path")


@query("hidden_filter_recursive", "SELECT path FROM v_file WHERE NOT starts_with(split_part(path, '/', 3), '.') "
       "AND NOT starts_with(split_part(path, '/', 2), '.')")
def _(v):
    return B.hidden_filter(v.file, "path", recursive=True).select("path")


# --- request log --------------------------------------------------------------

@query("audit_filter", """SELECT id, method FROM v_log WHERE method IN ('POST', 'PUT', 'PATCH', 'DELETE', 'HEAD', 'OPTIONS')
    AND coalesce(handler, '') <> 'get_captcha_for_login'
    AND NOT (coalesce(referer, '') LIKE '%docs' OR coalesce(referer, '') LIKE '%redoc')""")
def _(v):
    return B.audit_filter(v.log).select("id", "method")




@query("block_requests", """WITH black AS (SELECT DISTINCT peer FROM v_log WHERE latency > 200),
    white AS (SELECT DISTINCT peer FROM v_log WHERE latency < 1)
    SELECT id, peer AS ip, CASE WHEN peer IN (SELECT peer FROM black) THEN 'ip_black_list'
        WHEN method <> 'GET' AND peer NOT IN (SELECT peer FROM white) AND path NOT IN ('/signup') THEN 'demo_mode'
        END AS block_reason FROM v_log""")
def _(v):
    log = v.log.withColumnRenamed("peer", "ip")
    black = log.filter("latency > 200").select("ip")
    white = log.filter("latency < 1").select("ip")
    paths = log.filter("handler = 'signup'").select("path")
    return B.block_requests(log, black, white, paths, demo=True).select("id", "ip", "block_reason")


# --- row checks ---------------------------------------------------------------

@query("valid_contacts", """WITH t AS (SELECT id, replace(lower(name), '#', '.') || '@' || CASE segment
        WHEN 'BUILDING' THEN 'host' WHEN 'MACHINERY' THEN 'ex ample.com' ELSE 'example.com' END AS email,
        '1' || CASE segment WHEN 'BUILDING' THEN '2' WHEN 'FURNITURE' THEN '47' ELSE '38' END
            || right(name, CASE segment WHEN 'HOUSEHOLD' THEN 7 WHEN 'BUILDING' THEN 9 ELSE 8 END) AS mobile,
        CASE segment WHEN 'BUILDING' THEN '9' ELSE '' END || 'c_' || id AS code FROM v_user)
    SELECT id, regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$') AS email_ok,
        regexp_matches(mobile, '^1(3\\d|4[4-9]|5[0-35-9]|6[67]|7[013-8]|8[0-9]|9[0-9])\\d{8}$') AS mobile_ok,
        regexp_matches(mobile, '^1[3-9]\\d{9}$') AS phone_ok,
        regexp_matches(code, '^[A-Za-z][A-Za-z0-9_]{1,15}$') AS code_ok FROM t""")
def _(v):
    seg = F.col("segment")
    host = F.when(seg == "BUILDING", "host").when(seg == "MACHINERY", "ex ample.com").otherwise("example.com")
    email = F.concat(F.regexp_replace(F.lower("name"), "#", "."), F.lit("@"), host)
    size = F.when(seg == "HOUSEHOLD", 7).when(seg == "BUILDING", 9).otherwise(8)
    mobile = F.concat(F.lit("1"), F.when(seg == "BUILDING", "2").when(seg == "FURNITURE", "47").otherwise("38"),
                      F.right("name", size))
    code = F.concat(F.when(seg == "BUILDING", "9").otherwise(""), F.lit("c_"), F.col("id").cast("string"))
    t = v.user.select("id", email.alias("email"), mobile.alias("mobile"), code.alias("code"))
    return t.select("id", C.valid_email(F.col("email")).alias("email_ok"),
                    C.valid_mobile(F.col("mobile")).alias("mobile_ok"), C.is_phone(F.col("mobile")).alias("phone_ok"),
                    C.valid_code(F.col("code"), required=True).alias("code_ok"))


@query("regex_tests", """SELECT page_id, regexp_matches(url, 'page=\\d+') AS found, regexp_matches(url, '^(?:https)') AS at_start,
    regexp_matches(url, '^(git|https?|file)://([^/]*)((?:/[^/]*)*/)([^/]+?)(?:\\.git)?$') AS git_like FROM pages""")
def _(v):
    url = F.col("url")
    return v.pages.select("page_id", C.re_search(url, r"page=\d+").alias("found"),
                          C.re_match(url, "https").alias("at_start"), C.is_git_url(url).alias("git_like"))


@query("valid_row", """WITH t AS (SELECT p_partkey AS id, trim(CASE WHEN p_size > 25 THEN replace(p_name, ' ', '')
        WHEN p_size > 20 THEN repeat('x', p_size + 30) WHEN p_size > 15 THEN '--' WHEN p_size > 13 THEN ' ' ELSE p_name END) AS name,
        CASE WHEN p_type = 'PROMO' THEN '2' WHEN p_type = 'LARGE' THEN '1' ELSE '0' END AS status,
        repeat(p_brand, p_size) AS description FROM part)
    SELECT id, concat_ws(',', CASE WHEN name = '' THEN 'name_empty' END,
        CASE WHEN name <> '' AND NOT (length(name) BETWEEN 2 AND 50) THEN 'name_length' END,
        CASE WHEN name <> '' AND NOT (regexp_matches(name, '^[a-zA-Z0-9]+$') OR regexp_matches(name, '^[-_]+$')) THEN 'name_characters' END,
        CASE WHEN status NOT IN ('0', '1') THEN 'status' END,
        CASE WHEN length(description) > 255 THEN 'description_length' END) AS errors FROM t""")
def _(v):
    size = F.col("p_size")
    name = (F.when(size > 25, F.regexp_replace("p_name", " ", "")).when(size > 20, F.expr("repeat('x', p_size + 30)"))
            .when(size > 15, "--").when(size > 13, " ").otherwise(F.col("p_name")))
    rows = v.part.select(
        F.col("p_partkey").alias("id"), name.alias("name"),
        F.when(F.col("p_type") == "PROMO", "2").when(F.col("p_type") == "LARGE", "1").otherwise("0").alias("status"),
        F.expr("repeat(p_brand, p_size)").alias("description"))
    return rows.select("id", F.array_join(C.row_errors(C.demo_rules()), ",").alias("errors"))


@query("valid_menu", """SELECT id, concat_ws(',', CASE WHEN type IN (1, 2) AND client = 'app' THEN 'route_name' END,
        CASE WHEN type = 1 AND status = '1' THEN 'redirect' END,
        CASE WHEN type = 2 AND sort > 30 THEN 'component_path' END) AS errors FROM v_menu""")
def _(v):
    rows = v.menu.withColumn("route_name", F.when(F.col("client") == "pc", F.col("name"))).withColumn(
        "route_path", F.col("permission")).withColumn(
        "redirect", F.when(F.col("status") == "1", F.lit(" ")).otherwise(F.lit("/x"))).withColumn(
        "component_path", F.when(F.col("sort") <= 30, F.col("permission")))
    return rows.select("id", F.array_join(C.row_errors(C.menu_rules()), ",").alias("errors"))


@query("ip_checks", """SELECT id, peer, regexp_matches(peer, '^(127\\.|10\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|192\\.168\\.)') AS private_ip,
    regexp_matches(peer || code, '^((25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\\.){3}(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$') AS valid
    FROM v_log""")
def _(v):
    return v.log.select("id", "peer", C.is_private_ip(F.col("peer")).alias("private_ip"),
                        C.valid_ip(F.concat("peer", F.col("code").cast("string"))).alias("valid"))


# --- projections --------------------------------------------------------------

@query("project_out", "SELECT CAST(id AS VARCHAR) AS id, status, 'none' AS remark, CAST(NULL AS BIGINT) AS extra FROM v_order")
def _(v):
    schema = T.StructType.fromDDL("id string, status string, remark string, extra bigint")
    return project_out(v.order, schema, {"remark": "none"})


@query("label_codes", """SELECT id, CASE status WHEN '0' THEN '启用' WHEN '1' THEN '停用' ELSE '未知' END AS status,
    CASE type WHEN 1 THEN '登录日志' WHEN 2 THEN '操作日志' ELSE '未知' END AS type FROM v_menu""")
def _(v):
    return label_codes(v.menu, {"status": LABELS["status"], "type": LABELS["log_type"]}).select("id", "status", "type")


@query("response_label", "SELECT id, CASE WHEN code = 200 THEN '成功' ELSE '失败' END AS result FROM v_log")
def _(v):
    return v.log.select("id", response_label(F.col("code")).alias("result"))


@query("truncate_payload", "SELECT doc_id, CASE WHEN length(text) > 2000 THEN '请求参数过长' ELSE text END AS payload FROM documents")
def _(v):
    return v.documents.select("doc_id", X.truncate_payload(F.col("text")).alias("payload"))


@query("options", "SELECT id AS value, coalesce(name, '') AS label, sort FROM v_menu WHERE status = '0'")
def _(v):
    return options(v.menu, {"value": F.col("id"), "label": F.coalesce("name", F.lit("")), "sort": F.col("sort")})


@query("filter_keep_path", """WITH RECURSIVE hit AS (SELECT id, parent_id FROM v_menutree WHERE name LIKE '%red bolt%'
    UNION SELECT m.id, m.parent_id FROM v_menutree m JOIN hit ON m.id = hit.parent_id)
    SELECT id, name FROM v_menutree WHERE id IN (SELECT id FROM hit)""")
def _(v):
    return filter_keep_path(v.menutree, "name", "red bolt").select("id", "name")
