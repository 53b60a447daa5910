"""Joins, paging, set operations and differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegov.functions.text import minute_fmt
from tablegov.operators import diff as D
from tablegov.operators import ordering as O
from tablegov.operators import page as P
from tablegov.operators import relate as R
from tablegov.operators.scope import creator_in
from tablegov.plans.registry import query
from tablegov.session import cut

# --- joins --------------------------------------------------------------------


@query("order_creator", """SELECT o.id, o.amount, u.id AS creator_id, u.name AS creator_name FROM v_order o
    LEFT JOIN (SELECT * FROM v_user WHERE status = '0') u ON u.id = o.created_id""")
def _(v):
    live = v.user.filter("status = '0'")
    return R.with_one(v.order, live, "created_id", "created_by").select(
        "id", "amount", F.col("created_by.id").alias("creator_id"), F.col("created_by.name").alias("creator_name"))


@query("nation_customers_nest", """WITH u AS (SELECT dept_id, name, row_number() OVER (PARTITION BY dept_id ORDER BY name DESC, id) AS pos FROM v_user)
    SELECT d.id, d.name, coalesce((u.pos - 1) // 10000, 0) AS chunk_no, count(u.pos) AS n,
        coalesce(string_agg(u.name, ',' ORDER BY u.pos), '') AS names
    FROM v_dept d LEFT JOIN u ON u.dept_id = d.id GROUP BY 1, 2, 3""")
def _(v):
    out = R.with_many(v.dept, v.user, "dept_id", [("name", "desc"), ("id", "asc")], ["id", "name"], "users")
    return out.select("id", "name", "chunk_no", F.size("users").alias("n"),
                      F.array_join(F.transform("users", lambda u: u["name"]), ",").alias("names"))


@query("order_lines_chunks", """WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY
        l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS pos, l_partkey FROM lineitem)
    SELECT o.o_orderkey AS id, coalesce((l.pos - 1) // 3, 0) AS chunk_no, count(l.pos) AS n,
        coalesce(string_agg(CAST(l.l_partkey AS VARCHAR), ',' ORDER BY l.pos), '') AS parts
    FROM orders o LEFT JOIN l ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2""")
def _(v):
    orders = v.orders.select(F.col("o_orderkey").alias("id"))
    by = [("l_extendedprice", "desc"), "l_partkey", "l_suppkey", "l_linenumber"]
    out = R.with_many(orders, v.lineitem, "l_orderkey", by, ["l_partkey"], "lines", chunk=3)
    return out.select("id", "chunk_no", F.size("lines").alias("n"),
                      F.array_join(F.transform("lines", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


@query("supplier_parts_bridge", """WITH m AS (SELECT rm.role_id, m.id, row_number() OVER (PARTITION BY rm.role_id ORDER BY m.sort, m.id) AS pos
        FROM v_role_menu rm JOIN v_menu m ON m.id = rm.menu_id)
    SELECT r.id, coalesce((m.pos - 1) // 1000, 0) AS chunk_no, count(m.id) AS n,
        coalesce(string_agg(CAST(m.id AS VARCHAR), ',' ORDER BY m.pos), '') AS menus
    FROM v_role r LEFT JOIN m ON m.role_id = r.id GROUP BY 1, 2""")
def _(v):
    out = R.with_bridge(v.role, v.role_menu, v.menu, "role_id", "menu_id", ["sort", "id"], ["id", "name"], "menus",
                        chunk=1000)
    return out.select("id", "chunk_no", F.size("menus").alias("n"),
                      F.array_join(F.transform("menus", lambda m: m["id"].cast("string")), ",").alias("menus"))


@query("tenant_users", "SELECT l.id, l.user_id, u.name, l.is_default FROM v_link l JOIN v_user u ON u.id = l.user_id WHERE l.tenant_id = 3")
def _(v):
    return R.tenant_users(v.link, v.user, 3).select("id", "user_id", "name", "is_default")


@query("tenant_options", """SELECT t.id, t.name, l.is_default FROM v_link l JOIN v_tenant t ON t.id = l.tenant_id
    WHERE l.user_id = 11 AND t.status = '0' AND NOT t.is_deleted""")
def _(v):
    return R.tenant_options(v.link, v.tenant, 11)


@query("installed_plugins", "SELECT m.id, m.name, rm.role_id FROM v_menu m JOIN v_role_menu rm ON rm.menu_id = m.id WHERE rm.role_id = 4")
def _(v):
    links = v.role_menu.filter("role_id = 4").withColumnRenamed("menu_id", "plugin_id")
    return R.installed(v.menu, links, "plugin_id", ["sort", "id"]).select("id", "name", "role_id")


@query("flag_membership", "SELECT id, name, id IN (SELECT menu_id FROM v_role_menu WHERE role_id = 4) AS installed FROM v_menu")
def _(v):
    return R.flag_membership(v.menu, v.role_menu.filter("role_id = 4").select("menu_id"), "id").select(
        "id", "name", "installed")


@query("creator_in", "SELECT id FROM v_order WHERE created_id IN (SELECT id FROM v_user WHERE dept_id IN "
       "(SELECT id FROM v_dept WHERE parent_id = 1003))")
def _(v):
    depts = v.dept.filter("parent_id = 1003").select("id")
    return creator_in(v.order, v.user, depts).select("id")


@query("describe_tables", """SELECT p_partkey AS table_id, s.s_name AS namespace, coalesce(c.comment, '') AS comment FROM part
    JOIN supplier s ON s.s_nationkey = p_size LEFT JOIN (SELECT doc_id, source AS comment FROM documents) c ON c.doc_id = p_partkey""")
def _(v):
    tables = v.part.select(F.col("p_partkey").alias("table_id"), F.col("p_size").alias("namespace_id"))
    spaces = v.supplier.select(F.col("s_nationkey").alias("namespace_id"), F.col("s_name").alias("namespace"))
    comments = v.documents.select(F.col("doc_id").alias("table_id"), F.col("source").alias("comment"))
    return R.describe_tables(tables, spaces, comments).select("table_id", "namespace", "comment")


@query("insert_missing_links", """SELECT role_id, menu_id FROM v_role_menu UNION ALL
    SELECT DISTINCT s_suppkey, p_partkey FROM part JOIN supplier ON s_nationkey = p_size
    WHERE (s_suppkey, p_partkey) NOT IN (SELECT (role_id, menu_id) FROM v_role_menu)""")
def _(v):
    menus = v.part.select(F.col("p_partkey").alias("menu_id"), F.col("p_size").alias("nation"))
    roles = v.supplier.select(F.col("s_suppkey").alias("role_id"), F.col("s_nationkey").alias("nation"))
    return R.insert_missing(v.role_menu, menus, ["menu_id", "role_id"], roles, "nation")


@query("nation_parent_name", "SELECT d.id, d.name, p.name AS parent_name FROM v_dept d LEFT JOIN v_dept p ON p.id = d.parent_id")
def _(v):
    return R.with_parent_name(v.dept).select("id", "name", "parent_name")


@query("menu_parent_name", "SELECT d.id, p.name AS parent_name FROM v_menutree d LEFT JOIN v_menutree p ON p.id = d.parent_id")
def _(v):
    return R.with_parent_name(v.menutree).select("id", "parent_name")


def _fk(v):
    return R.resolve_fk(v.order.select("id", F.format_string("Customer#%09d", "created_id").alias("name")),
                        v.user.filter("status = '0'"), "name", name="user_id")


@query("resolve_fk", "SELECT o.id, u.id AS user_id FROM v_order o JOIN v_user u ON u.name = printf('Customer#%09d', o.created_id) AND u.status = '0'")
def _(v):
    return _fk(v)[0].select("id", "user_id")


@query("resolve_fk_rejects", "SELECT o.id FROM v_order o WHERE created_id NOT IN (SELECT id FROM v_user WHERE status = '0')")
def _(v):
    return _fk(v)[1].select("id")


# Tenants 1 to 4 have a list of allowed menus, tenant 0 has none.
_ALLOWED = "allowed AS (SELECT sort // 10 + 1 AS tenant_id, id AS menu_id FROM v_menu)"


def _allowed(v):
    return v.menu.select((F.floor(F.col("sort") / 10) + 1).alias("tenant_id"), F.col("id").alias("menu_id"))


def _role_tenants(v):
    return v.supplier.join(v.nation, F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.col("s_suppkey").alias("id"), F.col("n_regionkey").alias("tenant_id"))


@query("granted_parts", f"""WITH {_ALLOWED}, g AS (SELECT DISTINCT rm.role_id AS user_id, m.id AS menu_id, n_regionkey AS tenant_id FROM v_role_menu rm
        JOIN v_menu m ON m.id = rm.menu_id JOIN supplier ON s_suppkey = rm.role_id JOIN nation ON n_nationkey = s_nationkey
        WHERE m.status = '0' AND m.type IN (1, 2, 4) AND m.client = 'pc')
    SELECT user_id, menu_id FROM g WHERE tenant_id NOT IN (SELECT tenant_id FROM allowed)
        OR (tenant_id, menu_id) IN (SELECT (tenant_id, menu_id) FROM allowed)""")
def _(v):
    roles = v.role.select(F.col("id").alias("user_id"), F.col("id").alias("role_id"))
    return R.granted_menus(roles, v.role_menu, v.menu, _allowed(v), _role_tenants(v))


@query("granted_parts_of_user", f"""WITH {_ALLOWED}, g AS (SELECT DISTINCT rm.role_id AS user_id, m.id AS menu_id, n_regionkey AS tenant_id FROM v_role_menu rm
        JOIN v_menu m ON m.id = rm.menu_id JOIN supplier ON s_suppkey = rm.role_id JOIN nation ON n_nationkey = s_nationkey
        WHERE m.status = '0' AND m.type IN (1, 2, 4) AND m.client = 'pc' AND rm.role_id = 7)
    SELECT user_id, menu_id FROM g WHERE tenant_id NOT IN (SELECT tenant_id FROM allowed)
        OR (tenant_id, menu_id) IN (SELECT (tenant_id, menu_id) FROM allowed)""")
def _(v):
    roles = v.role.select(F.col("id").alias("user_id"), F.col("id").alias("role_id"))
    return R.granted_menus(roles, v.role_menu, v.menu, _allowed(v), _role_tenants(v), user_id=7)


@query("session_dept", """SELECT c.conv_id, c.turn, d.name AS team_name FROM conversations c LEFT JOIN v_dept d
    ON d.id = TRY_CAST(CASE WHEN c.role = 'system' THEN 'team' ELSE CAST(c.turn AS VARCHAR) END AS BIGINT)""")
def _(v):
    team = F.when(F.col("role") == "system", "team").otherwise(F.col("turn").cast("string"))
    return R.session_dept(v.conversations.withColumn("team_id", team), v.dept).select("conv_id", "turn", "team_name")


@query("dependents_report", """SELECT id, 'orders' AS reason FROM v_user WHERE id IN (SELECT created_id FROM v_order)
    UNION ALL SELECT id, 'links' FROM v_user WHERE id IN (SELECT user_id FROM v_link WHERE is_owner)
    UNION ALL SELECT id, 'events' FROM v_user WHERE id IN (SELECT user_id FROM events)""")
def _(v):
    return R.referential_guard(v.user, {"orders": (v.order, "created_id"), "links": (v.link.filter("is_owner"), "user_id"),
                                        "events": (v.events, "user_id")})


@query("menu_grant_check", f"""WITH {_ALLOWED}, own AS (SELECT rm.role_id, rm.menu_id, n_regionkey AS tenant_id FROM v_role_menu rm
        JOIN supplier ON s_suppkey = rm.role_id JOIN nation ON n_nationkey = s_nationkey)
    SELECT role_id, menu_id, tenant_id FROM own WHERE tenant_id IN (SELECT tenant_id FROM allowed)
        AND (tenant_id, menu_id) NOT IN (SELECT (tenant_id, menu_id) FROM allowed)""")
def _(v):
    own = v.role_menu.join(_role_tenants(v).withColumnRenamed("id", "role_id"), "role_id")
    return R.menu_grant_check(own, _allowed(v)).select("role_id", "menu_id", "tenant_id")


@query("member_of", """SELECT e.event_id, e.user_id, u.tenant_id FROM events e JOIN v_user u ON u.id = e.user_id
    WHERE (e.user_id, u.tenant_id) IN (SELECT (user_id, tenant_id) FROM v_link)
    AND u.tenant_id IN (SELECT id FROM v_tenant WHERE status = '0')""")
def _(v):
    pairs = v.events.join(v.user.select(F.col("id").alias("user_id"), "tenant_id"), "user_id")
    return R.member_of(pairs, v.link, v.tenant).select("event_id", "user_id", "tenant_id")


# --- sorting and paging -------------------------------------------------------

@query("count_orders", "SELECT count(id) AS total FROM v_order WHERE status = 'O'")
def _(v):
    return P.count_rows(v.order.filter("status = 'O'"), "id")


@query("count_where", "SELECT tenant_id, count(*) AS n FROM v_link WHERE is_owner GROUP BY tenant_id")
def _(v):
    return P.count_where(v.link, {"is_owner": True}, ["tenant_id"])


@query("order_by", "SELECT id, status, row_number() OVER (ORDER BY status DESC, amount, id) AS position FROM v_order")
def _(v):
    return O.number_rows(v.order, [*O.normalise([{"status": "desc"}, {"amount": "whatever"}]), ("id", "asc")], "position",
                         small_rows=0).select("id", "status", "position")


@query("page", "SELECT id, amount, (SELECT count(*) FROM v_order WHERE status = 'P') AS total, 3 AS page_no, 50 AS page_size, "
       "150 < (SELECT count(*) FROM v_order WHERE status = 'P') AS has_next "
       "FROM v_order WHERE status = 'P' ORDER BY amount DESC, id LIMIT 50 OFFSET 100")
def _(v):
    return P.page_frame(v.order, 3, 50, [("amount", "desc")], {"status": "P"}).select(
        "id", "amount", "total", "page_no", "page_size", "has_next")


@query("page_list", "SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 10 OFFSET 30")
def _(v):
    docs = v.documents.select("doc_id", "source")
    return P.page(docs, 4, 10, ["source"], key="doc_id").items


@query("keyset_orders", """SELECT id, amount FROM v_order WHERE (updated_time < (SELECT updated_time FROM v_order WHERE id = 77)
    OR (updated_time = (SELECT updated_time FROM v_order WHERE id = 77) AND id > 77))
    ORDER BY updated_time DESC, id LIMIT 40""")
def _(v):
    orders = v.order
    last = orders.filter("id = 77").select("updated_time", "id").first().asDict()
    return P.keyset_page(orders, [("updated_time", "desc")], last, 40).select("id", "amount")


@query("deep_page", "SELECT id, amount FROM v_order ORDER BY amount, id LIMIT 100 OFFSET 12000")
def _(v):
    return P.page(v.order, 121, 100, ["amount"]).items.select("id", "amount")


@query("top_orders", "SELECT id, amount FROM v_order ORDER BY created_time DESC, id DESC LIMIT 5")
def _(v):
    return P.latest(v.order, 5).select("id", "amount")


@query("get_one", "SELECT id, amount FROM v_order WHERE created_id = 9 ORDER BY id LIMIT 1")
def _(v):
    return P.get_one(v.order, {"created_id": 9}).select("id", "amount")


@query("sort_items", "SELECT path, size, row_number() OVER (ORDER BY size DESC, path) AS position FROM v_file")
def _(v):
    # Numbering reads the listing several times.
    items = cut(P.sort_items(v.file, [{"field": "size", "direction": "desc"}, {"field": "path"}]))
    return O.number_rows(items, [("size", "desc"), ("path", "asc")], "position")


@query("sort_desc_by_login", "SELECT id, name, coalesce(login_time, '') AS login_time FROM (SELECT id, name, "
       "CASE WHEN status = '0' THEN segment END AS login_time FROM v_user)")
def _(v):
    rows = v.user.withColumn("login_time", F.when(F.col("status") == "0", F.col("segment")))
    return P.sort_desc_by_login(rows).select("id", "name", F.coalesce("login_time", F.lit("")).alias("login_time"))


# --- set operations -----------------------------------------------------------

@query("feed", """(SELECT doc_id AS id, source AS title, '' AS time, 'notice' AS type FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5)
    UNION ALL (SELECT id, path, strftime(ts, '%Y-%m-%d %H:%M'), 'system' FROM v_log ORDER BY ts DESC, id DESC LIMIT 5)""")
def _(v):
    notices = v.documents.orderBy(F.col("n_chars").desc(), "doc_id").limit(5)
    logs = P.latest(v.log, 5, "ts")
    return P.feed([
        (notices, {"id": F.col("doc_id"), "title": F.col("source"), "time": F.lit(""), "type": F.lit("notice")}),
        (logs, {"id": F.col("id"), "title": F.col("path"), "time": minute_fmt(F.col("ts")), "type": F.lit("system")})])


@query("union_ids", "SELECT created_id AS id FROM v_order WHERE status = 'O' UNION SELECT user_id FROM events WHERE event_type = 'click'")
def _(v):
    return P.union_ids([v.order.filter("status = 'O'").select(F.col("created_id").alias("id")),
                        v.events.filter("event_type = 'click'").select(F.col("user_id").alias("id"))])


@query("granted_intersect", "SELECT menu_id FROM v_role_menu WHERE role_id = 3 INTERSECT SELECT id FROM v_menu WHERE sort < 30")
def _(v):
    return P.intersect_ids(v.role_menu.filter("role_id = 3").select("menu_id"),
                           v.menu.filter("sort < 30").select(F.col("id").alias("menu_id")))


@query("dedupe", "SELECT arg_max(event_id, (ts, event_id)) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type")
def _(v):
    return P.dedupe(v.events, ["user_id", "event_type"], [("ts", "desc"), ("event_id", "desc")]).select(
        "event_id", "user_id", "event_type")


@query("dedupe_any", "SELECT DISTINCT p_name AS name FROM part")
def _(v):
    return P.dedupe(v.part.select(F.col("p_name").alias("name")), ["name"])


# --- differences --------------------------------------------------------------

_NEW = """new AS (SELECT id + CASE WHEN status = 'P' AND amount > 300000 THEN 1000000000 ELSE 0 END AS id,
    CASE WHEN description LIKE '2-%' THEN NULL ELSE description END AS description,
    CASE WHEN amount < 100000 THEN 'Z' ELSE status END AS status FROM v_order)"""


@query("orders_diff", f"""WITH {_NEW} SELECT coalesce(o.id, n.id) AS id,
    CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change,
    CASE WHEN o.id IS NOT NULL AND n.id IS NOT NULL THEN concat_ws(',',
        CASE WHEN o.description IS DISTINCT FROM n.description THEN 'description' END,
        CASE WHEN o.status IS DISTINCT FROM n.status THEN 'status' END) ELSE '' END AS fields
    FROM v_order o FULL JOIN new n ON n.id = o.id
    WHERE o.id IS NULL OR n.id IS NULL OR o.description IS DISTINCT FROM n.description OR o.status IS DISTINCT FROM n.status""")
def _(v):
    new = v.order.select(
        (F.col("id") + F.when((F.col("status") == "P") & (F.col("amount") > 300000), 1000000000).otherwise(0)).alias("id"),
        F.when(F.col("description").like("2-%"), None).otherwise(F.col("description")).alias("description"),
        F.when(F.col("amount") < 100000, "Z").otherwise(F.col("status")).alias("status"))
    out = D.snapshot_diff(v.order.select("id", "description", "status"), new, ["id"])
    return out.select("id", "change", F.array_join("change_fields", ",").alias("fields"))


@query("row_diff", "SELECT 'removed' AS side, source, lang FROM (SELECT source, lang FROM documents EXCEPT ALL "
       "SELECT source, lang FROM documents JOIN labels USING (doc_id))")
def _(v):
    docs = v.documents.select("source", "lang")
    labelled = v.documents.join(v.labels.select("doc_id"), "doc_id", "left_semi").select("source", "lang")
    return D.row_diff(docs, labelled)[1].select(F.lit("removed").alias("side"), "source", "lang")


_COLUMNS = """{name} AS (SELECT p_brand AS table_name, p_brand || '.' || p_name || '.' || p_partkey AS column_name, {type} AS column_type,
    {comment} AS column_comment, p_size = 7 AS is_pk, p_size > 25 AS is_nullable FROM part WHERE {keep})"""
_CUR = _COLUMNS.format(name="cur", type="p_type", comment="CAST(p_size AS VARCHAR)", keep="p_size < 48")
_INC = _COLUMNS.format(name="inc", type="CASE WHEN p_type = 'PROMO' THEN 'LARGE' ELSE p_type END",
                       comment="CASE WHEN p_size < 10 THEN '' ELSE CAST(p_size AS VARCHAR) END", keep="p_size > 2")


def _columns(v, incoming: bool):
    p = v.part
    kind, note, keep = F.col("p_type"), F.col("p_size").cast("string"), F.col("p_size") < 48
    if incoming:
        kind = F.when(F.col("p_type") == "PROMO", "LARGE").otherwise(F.col("p_type"))
        note = F.when(F.col("p_size") < 10, "").otherwise(note)
        keep = F.col("p_size") > 2
    return p.filter(keep).select(
        F.col("p_brand").alias("table_name"),
        F.concat_ws(".", "p_brand", "p_name", F.col("p_partkey").cast("string")).alias("column_name"),
        kind.alias("column_type"), note.alias("column_comment"), F.lit(None).cast("string").alias("column_default"),
        F.lit(0).alias("column_length"), (F.col("p_size") == 7).alias("is_pk"), F.lit(False).alias("is_increment"),
        (F.col("p_size") > 25).alias("is_nullable"), F.lit(False).alias("is_unique"))


@query("schema_diff", f"""WITH {_CUR}, {_INC} SELECT coalesce(c.column_name, i.column_name) AS column_name,
    CASE WHEN c.column_name IS NULL THEN 'added' WHEN i.column_name IS NULL THEN 'removed'
        WHEN c.column_type <> i.column_type OR c.column_comment <> i.column_comment THEN 'changed' ELSE 'unchanged' END AS change,
    CASE WHEN c.column_name IS NULL OR i.column_name IS NULL THEN '' ELSE concat_ws(',',
        CASE WHEN c.column_type <> i.column_type THEN 'column_type' END,
        CASE WHEN c.column_comment <> i.column_comment THEN 'column_comment' END) END AS fields
    FROM cur c FULL JOIN inc i ON i.column_name = c.column_name""")
def _(v):
    out = D.schema_diff(_columns(v, False), _columns(v, True))
    return out.select("column_name", "change", F.array_join("change_fields", ",").alias("fields"))


@query("schema_diff_summary", f"""WITH {_CUR}, {_INC} SELECT CASE WHEN c.column_name IS NULL THEN 'added'
        WHEN i.column_name IS NULL THEN 'removed'
        WHEN c.column_type <> i.column_type OR c.column_comment <> i.column_comment THEN 'changed' ELSE 'unchanged' END AS change,
    count(*) AS n FROM cur c FULL JOIN inc i ON i.column_name = c.column_name GROUP BY 1""")
def _(v):
    return D.diff_summary(D.schema_diff(_columns(v, False), _columns(v, True)))


@query("sync_columns", f"""WITH {_CUR}, {_INC} SELECT i.column_name, i.column_type,
        CASE WHEN NOT i.is_pk AND c.column_name IS NOT NULL THEN NOT c.is_nullable ELSE i.is_nullable END AS is_nullable,
        CASE WHEN i.is_pk THEN false WHEN c.column_name IS NOT NULL THEN c.column_type = 'SMALL' ELSE true END AS is_list,
        CASE WHEN i.is_pk THEN NULL WHEN c.column_comment = '30' THEN 'EQ' ELSE 'LIKE' END AS query_type,
        CASE WHEN c.column_type = 'LARGE' THEN 'select' ELSE 'textarea' END AS html_type
    FROM inc i LEFT JOIN cur c ON c.column_name = i.column_name""")
def _(v):
    cur = _columns(v, False).withColumn("is_list", F.col("column_type") == "SMALL").withColumn(
        "query_type", F.when(F.col("column_comment") == "30", "EQ").otherwise("")).withColumn(
        "html_type", F.when(F.col("column_type") == "LARGE", "select").otherwise("input")).withColumn(
        "is_nullable", ~F.col("is_nullable"))
    inc = _columns(v, True).withColumn("is_list", F.lit(True)).withColumn("query_type", F.lit("LIKE")).withColumn(
        "html_type", F.lit("textarea"))
    return D.sync_columns(cur, inc, ["table_name", "column_name"]).select(
        "column_name", "column_type", "is_nullable", "is_list", "query_type", "html_type")
