"""Mutations as snapshot transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegov.functions.checks import demo_rules, split_valid
from tablegov.functions.text import fmt_ts
from tablegov.operators import mutate as U
from tablegov.operators import quality as Q
from tablegov.plans.registry import query
from tablegov.plans.views import Views
from tablegov.spec import Ctx, TableSpec

NOW = "2024-06-01 12:00:00"
ORDER = TableSpec("order")
HARD = TableSpec("order", deleted_time=None)
CTX = Ctx(user_id=7, tenant_id=2)
_COLS = ["id", "tenant_id", "status", "is_deleted", "deleted_time", "deleted_id"]
_SEL = """SELECT id, tenant_id, status, {deleted} AS is_deleted, strftime({time}, '%Y-%m-%d %H:%M:%S') AS deleted_time,
    {by} AS deleted_id FROM v_torder"""
_PICK = "(SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.09)"


def _picked(v: Views):
    return v.lineitem.filter("l_discount >= 0.09").select(F.col("l_orderkey").alias("id"))


def _shape(df):
    return df.select(*[fmt_ts(F.col(c)).alias(c) if c == "deleted_time" else F.col(c) for c in _COLS])


# --- create and update --------------------------------------------------------

@query("create", """SELECT id, name, dept_id, tenant_id, status, balance FROM (SELECT id, name, dept_id, tenant_id, status, balance FROM v_user
    UNION ALL SELECT (SELECT max(id) FROM v_user) + row_number() OVER (ORDER BY s_acctbal, s_suppkey), s_name, s_nationkey, 2, '0', s_acctbal FROM supplier)""")
def _(v):
    users = v.user.select("id", "name", "dept_id", "tenant_id", "status", "balance")
    rows = v.supplier.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("dept_id"),
                             F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("_key"))
    spec = TableSpec("user", creator=None, updater=None, created_time=None, updated_time=None, deleted=None)
    return U.create(users, rows, spec, CTX, ["balance", "_key"], NOW)


_CHANGES = """ch AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'X' END AS status, o_totalprice + 1 AS amount
    FROM orders WHERE o_orderpriority = '2-HIGH')"""


def _changes(v):
    return v.orders.filter("o_orderpriority = '2-HIGH'").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "F", "X").alias("status"),
        (F.col("o_totalprice") + 1).alias("amount"))


@query("partial_update", f"""WITH {_CHANGES} SELECT o.id, CASE WHEN ch.id IS NOT NULL AND tenant_id = 2 AND NOT is_deleted THEN coalesce(ch.status, o.status) ELSE o.status END AS status,
    CASE WHEN ch.id IS NOT NULL AND tenant_id = 2 AND NOT is_deleted THEN ch.amount ELSE o.amount END AS amount,
    CASE WHEN ch.id IS NOT NULL AND tenant_id = 2 AND NOT is_deleted THEN 7 ELSE o.updated_id END AS updated_id,
    CASE WHEN ch.id IS NOT NULL AND tenant_id = 2 AND NOT is_deleted THEN '{NOW}' ELSE strftime(o.updated_time, '%Y-%m-%d %H:%M:%S') END AS updated_time
    FROM v_torder o LEFT JOIN ch ON ch.id = o.id""")
def _(v):
    out, _refused = U.update(v.torder, _changes(v), ORDER, CTX, NOW)
    return out.select("id", "status", "amount", "updated_id", fmt_ts(F.col("updated_time")).alias("updated_time"))


@query("partial_update_rejects", f"""WITH {_CHANGES}, more AS (SELECT id FROM ch UNION ALL SELECT id + 1000000000 FROM ch WHERE status IS NULL)
    SELECT m.id, CASE WHEN o.id IS NULL THEN 'not_found' WHEN o.tenant_id <> 2 THEN 'foreign_tenant' ELSE 'deleted' END AS reason
    FROM more m LEFT JOIN v_torder o ON o.id = m.id WHERE o.id IS NULL OR o.tenant_id <> 2 OR o.is_deleted""")
def _(v):
    changes = _changes(v)
    lost = changes.filter("status is null").withColumn("id", F.col("id") + 1000000000)
    return U.update(v.torder, changes.unionByName(lost), ORDER, CTX, NOW)[1].select("id", "reason")


_GOVERNED = """ch AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'X' END AS status FROM orders WHERE o_custkey % 3 = 0
        UNION ALL SELECT o_orderkey, 'Y' FROM orders WHERE o_custkey % 3 = 0 AND o_orderpriority = '1-URGENT'),
    n AS (SELECT id, min(status) AS status, count(*) AS times FROM ch GROUP BY id),
    j AS (SELECT n.id AS cid, n.status AS new_status, n.times, o.*, CASE WHEN o.id IS NULL THEN 'not_found' WHEN o.tenant_id <> 2 THEN 'foreign_tenant'
        WHEN o.is_deleted THEN 'deleted' WHEN NOT (o.amount > 50000) THEN 'out_of_scope' WHEN n.times > 1 THEN 'repeated' END AS reason
        FROM n LEFT JOIN v_torder o ON o.id = n.id)"""


def _governed(v: Views):
    status = F.when(F.col("o_orderstatus") == "O", "X").alias("status")
    picked = v.orders.filter("o_custkey % 3 = 0")
    changes = picked.select(F.col("o_orderkey").alias("id"), status).unionByName(picked.filter(
        "o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"), F.lit("Y").alias("status")))
    return U.update(v.torder, changes, ORDER, CTX, NOW, scope=F.col("amount") > 50000, given=["status"])


@query("governed_update", f"""WITH {_GOVERNED} SELECT o.id, CASE WHEN j.cid IS NOT NULL AND j.reason IS NULL THEN j.new_status ELSE o.status END AS status
    FROM v_torder o LEFT JOIN j ON j.cid = o.id""")
def _(v):
    return _governed(v)[0].select("id", "status")


@query("governed_update_rejects", f"WITH {_GOVERNED} SELECT cid AS id, reason, count(*) AS changes FROM j JOIN ch ON ch.id = cid WHERE reason IS NOT NULL GROUP BY 1, 2")
def _(v):
    return _governed(v)[1].groupBy("id", "reason").agg(F.count(F.lit(1)).alias("changes"))


@query("bulk_set", f"SELECT id, CASE WHEN tenant_id = 2 AND id IN {_PICK} THEN 'C' ELSE status END AS status FROM v_torder")
def _(v):
    return U.set_values(v.torder, _picked(v), {"status": "C"}, ORDER, CTX).select("id", "status")


@query("toggle", "SELECT id, CASE WHEN tenant_id = 2 AND id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN "
       "CASE status WHEN '0' THEN '1' ELSE '0' END ELSE status END AS status FROM v_user")
def _(v):
    ids = v.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return U.toggle(v.user, "status", ids, ORDER, CTX).select("id", "status")


# --- delete and restore -------------------------------------------------------

_HIT = f"tenant_id = 2 AND id IN {_PICK}"


@query("soft_delete", _SEL.format(deleted=f"is_deleted OR ({_HIT})", by=f"CASE WHEN {_HIT} THEN 7 ELSE deleted_id END",
                                  time=f"CASE WHEN {_HIT} THEN TIMESTAMP '{NOW}' ELSE deleted_time END"))
def _(v):
    return _shape(U.soft_delete(v.torder, _picked(v), ORDER, CTX, NOW))


@query("hard_delete", f"SELECT id FROM v_torder WHERE NOT ({_HIT})")
def _(v):
    return U.soft_delete(v.torder, _picked(v), HARD, CTX).select("id")


@query("restore", _SEL.format(deleted=f"is_deleted AND NOT ({_HIT})", by=f"CASE WHEN NOT ({_HIT}) THEN deleted_id END",
                              time=f"CASE WHEN NOT ({_HIT}) THEN deleted_time END"))
def _(v):
    return _shape(U.restore(v.torder, _picked(v), ORDER, CTX))


@query("clear", _SEL.format(deleted="is_deleted OR tenant_id = 2", by="CASE WHEN tenant_id = 2 THEN 7 ELSE deleted_id END",
                            time=f"CASE WHEN tenant_id = 2 THEN TIMESTAMP '{NOW}' ELSE deleted_time END"))
def _(v):
    return _shape(U.clear(v.torder, ORDER, CTX, NOW))


# --- upserts ------------------------------------------------------------------

@query("upsert", """WITH cfg AS (SELECT p_brand AS tenant, p_name AS key, min(p_type) AS value, CASE WHEN min(p_size) < 20 THEN 'string' ELSE 'number' END AS type
        FROM part WHERE p_size > 10 GROUP BY 1, 2),
    new AS (SELECT p_brand AS tenant, p_name AS key, max(p_type) AS value, CASE WHEN max(p_size) > 40 THEN 'bool' END AS type FROM part GROUP BY 1, 2)
    SELECT coalesce(c.tenant, n.tenant) AS tenant, coalesce(c.key, n.key) AS key, coalesce(n.value, c.value) AS value,
        coalesce(n.type, c.type, 'string') AS type FROM cfg c FULL JOIN new n ON n.tenant = c.tenant AND n.key = c.key""")
def _(v):
    parts = v.part.select(F.col("p_brand").alias("tenant"), F.col("p_name").alias("key"), "p_type", "p_size")
    cfg = parts.filter("p_size > 10").groupBy("tenant", "key").agg(
        F.min("p_type").alias("value"), F.when(F.min("p_size") < 20, "string").otherwise("number").alias("type"))
    new = parts.groupBy("tenant", "key").agg(
        F.max("p_type").alias("value"), F.when(F.max("p_size") > 40, "bool").alias("type"))
    return U.upsert(cfg, new, ["tenant", "key"], {"type": "string"})


_IMPORT = """rows AS (SELECT p_name || ' ' || p_brand AS name, CASE WHEN p_type = 'PROMO' THEN '1' ELSE '0' END AS status, p_type AS description,
        row_number() OVER (ORDER BY p_partkey) AS row_no FROM part),
    have AS (SELECT p_name || ' ' || p_brand AS name, min(p_partkey) AS id, '0' AS status, 'old' AS description, bool_or(p_size > 48) AS locked
        FROM part WHERE p_size > 40 GROUP BY 1),
    rep AS (SELECT r.*, h.id, CASE WHEN h.locked THEN 'refused' WHEN h.id IS NULL AND r.row_no = min(r.row_no) OVER (PARTITION BY r.name) THEN 'created'
        ELSE {known} END AS outcome FROM rows r LEFT JOIN have h ON h.name = r.name)"""


def _import(v: Views, update: bool):
    name = F.concat_ws(" ", "p_name", "p_brand").alias("name")
    rows = Q.with_row_no(v.part, ["p_partkey"]).select(
        name, F.when(F.col("p_type") == "PROMO", "1").otherwise("0").alias("status"),
        F.col("p_type").alias("description"), "row_no")
    have = v.part.filter("p_size > 40").groupBy(name).agg(
        F.min("p_partkey").alias("id"), F.lit("0").alias("status"), F.lit("old").alias("description"),
        (F.max("p_size") > 48).alias("locked"))
    spec = TableSpec("demo", tenant=None, creator=None, updater=None, created_time=None, updated_time=None, deleted=None)
    return U.import_upsert(have, rows, "name", update, spec, CTX, protected=F.col("locked"))


@query("import_report", f"WITH {_IMPORT.format(known=chr(39) + 'exists' + chr(39))} SELECT row_no, name, outcome FROM rep")
def _(v):
    return _import(v, False)[1]


@query("import_summary", f"""WITH {_IMPORT.format(known=chr(39) + 'updated' + chr(39))} SELECT count_if(outcome IN ('created', 'updated')) AS success_count,
    count_if(outcome NOT IN ('created', 'updated')) AS error_count FROM rep""")
def _(v):
    return Q.import_summary(_import(v, True)[1])


@query("import_error_lines", f"""WITH {_IMPORT.format(known=chr(39) + 'exists' + chr(39))} SELECT row_no, printf('row %d: %s %s', row_no, name, outcome) AS line
    FROM rep WHERE outcome NOT IN ('created', 'updated')""")
def _(v):
    return Q.error_lines(_import(v, False)[1], "name")


@query("import_upsert", f"""WITH {_IMPORT.format(known=chr(39) + 'updated' + chr(39))},
    last AS (SELECT name, arg_max(status, row_no) AS status, arg_max(description, row_no) AS description FROM rep
        WHERE outcome IN ('created', 'updated') GROUP BY name)
    SELECT h.id, h.name, coalesce(l.status, h.status) AS status, coalesce(l.description, h.description) AS description FROM have h LEFT JOIN last l ON l.name = h.name
    UNION ALL SELECT (SELECT max(id) FROM have) + row_number() OVER (ORDER BY l.name), l.name, l.status, l.description
    FROM last l WHERE l.name NOT IN (SELECT name FROM have)""")
def _(v):
    return _import(v, True)[0].select("id", "name", "status", "description")


_FOLD = """rows AS (SELECT p_name || ' ' || p_brand AS name, CASE WHEN p_type = 'PROMO' THEN '1' WHEN p_size % 3 = 0 THEN '0' END AS status,
        CASE WHEN p_size % 2 = 0 THEN p_type END AS description, row_number() OVER (ORDER BY p_partkey) AS row_no FROM part),
    have AS (SELECT p_name || ' ' || p_brand AS name, min(p_partkey) AS id, '0' AS status, 'old' AS description, max(p_size) = 50 AS is_deleted
        FROM part WHERE p_size > 40 GROUP BY 1),
    rep AS (SELECT r.*, h.id, CASE WHEN h.is_deleted THEN 'deleted' WHEN h.id IS NULL AND r.row_no = min(r.row_no) OVER (PARTITION BY r.name) THEN 'created'
        ELSE 'updated' END AS outcome FROM rows r LEFT JOIN have h ON h.name = r.name),
    last AS (SELECT name, arg_max(status, row_no) FILTER (status IS NOT NULL) AS status,
        arg_max(description, row_no) FILTER (description IS NOT NULL) AS description FROM rep WHERE outcome <> 'deleted' GROUP BY name)"""


def _fold(v: Views):
    """Rows that repeat their key with nulls, and rows whose key a deleted row has."""
    name = F.concat_ws(" ", "p_name", "p_brand").alias("name")
    rows = Q.with_row_no(v.part, ["p_partkey"]).select(
        name, F.when(F.col("p_type") == "PROMO", "1").when(F.col("p_size") % 3 == 0, "0").alias("status"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("description"), "row_no")
    have = v.part.filter("p_size > 40").groupBy(name).agg(
        F.min("p_partkey").alias("id"), F.lit("0").alias("status"), F.lit("old").alias("description"),
        (F.max("p_size") == 50).alias("is_deleted"))
    return have, rows, TableSpec("demo", tenant=None, creator=None, updater=None, created_time=None, updated_time=None)


@query("import_fold", f"""WITH {_FOLD}
    SELECT h.id, h.name, coalesce(l.status, h.status) AS status, coalesce(l.description, h.description) AS description, is_deleted
    FROM have h LEFT JOIN last l ON l.name = h.name
    UNION ALL SELECT (SELECT max(id) FROM have) + row_number() OVER (ORDER BY l.name), l.name, coalesce(l.status, '0'), l.description, false
    FROM last l WHERE l.name NOT IN (SELECT name FROM have)""")
def _(v):
    have, rows, spec = _fold(v)
    out = U.import_upsert(have, rows, "name", True, spec, CTX)[0]
    return out.select("id", "name", "status", "description", F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"))


@query("import_fold_report", f"WITH {_FOLD} SELECT row_no, name, outcome FROM rep")
def _(v):
    have, rows, spec = _fold(v)
    return U.import_upsert(have, rows, "name", True, spec, CTX)[1]


@query("upsert_ordered", f"""WITH {_FOLD}, all_of AS (SELECT name, arg_max(status, row_no) FILTER (status IS NOT NULL) AS status,
        arg_max(description, row_no) FILTER (description IS NOT NULL) AS description FROM rows GROUP BY name)
    SELECT coalesce(h.name, a.name) AS name, coalesce(a.status, h.status, '9') AS status, coalesce(a.description, h.description) AS description
    FROM have h FULL JOIN all_of a ON a.name = h.name""")
def _(v):
    have, rows, _spec = _fold(v)
    return U.upsert(have.select("name", "status", "description"), rows, ["name"], {"status": "9"}, order="row_no")


_DEMO = """t AS (SELECT p_partkey AS id, replace(p_name, ' ', CASE WHEN p_size > 25 THEN '' ELSE ' ' END) AS name, '0' AS status, repeat(p_type, p_size) AS description FROM part)"""
_OK = "regexp_matches(name, '^[a-zA-Z0-9]+$') AND length(name) BETWEEN 2 AND 50 AND length(description) <= 255"


def _checked(v):
    name = F.when(F.col("p_size") > 25, F.regexp_replace("p_name", " ", "")).otherwise(F.col("p_name"))
    rows = v.part.select(F.col("p_partkey").alias("id"), name.alias("name"), F.lit("0").alias("status"),
                         F.expr("repeat(p_type, p_size)").alias("description"))
    return split_valid(rows, demo_rules())


@query("import_valid", f"WITH {_DEMO} SELECT id, name FROM t WHERE {_OK}")
def _(v):
    return _checked(v)[0].select("id", "name")


@query("import_invalid", f"WITH {_DEMO} SELECT id, name FROM t WHERE NOT ({_OK})")
def _(v):
    return _checked(v)[1].select("id", "name")


_RAW = """raw AS (SELECT p_name AS name, 2 + p_partkey % 2 AS tenant_id, p_type AS kind, p_size AS size FROM part)"""


@query("upsert_tenant", f"""WITH {_RAW}, cfg AS (SELECT tenant_id, name, min(kind) AS kind FROM raw WHERE size <= 40 GROUP BY 1, 2),
    best AS (SELECT name, max(kind) AS kind FROM raw WHERE size > 20 AND tenant_id = 2 GROUP BY 1)
    SELECT tenant_id, name, kind FROM cfg WHERE tenant_id <> 2 UNION ALL
    SELECT 2, coalesce(c.name, b.name), coalesce(b.kind, c.kind) FROM (SELECT * FROM cfg WHERE tenant_id = 2) c FULL JOIN best b ON b.name = c.name""")
def _(v):
    raw = v.part.select(F.col("p_name").alias("name"), (2 + F.col("p_partkey") % 2).cast("int").alias("tenant_id"),
                        F.col("p_type").alias("kind"), F.col("p_size").alias("size"))
    cfg = raw.filter("size <= 40").groupBy("tenant_id", "name").agg(F.min("kind").alias("kind"))
    rows = raw.filter("size > 20").select("tenant_id", "name", "kind")
    return U.upsert(cfg, rows, ["tenant_id", "name"], None, TableSpec("cfg"), CTX)


# --- links --------------------------------------------------------------------

@query("exclusive_default", "SELECT id, user_id, CASE WHEN user_id = 11 THEN id = (SELECT max(id) FROM v_link WHERE user_id = 11) ELSE is_default END AS is_default FROM v_link")
def _(v):
    last = v.link.filter("user_id = 11").agg(F.max("id")).scalar()
    return U.exclusive_default(v.link, 11, last).select("id", "user_id", "is_default")


@query("replace_links", """SELECT role_id, menu_id FROM v_role_menu WHERE role_id NOT IN (SELECT id FROM v_role WHERE status = '1')
    UNION ALL SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey IN (SELECT id FROM v_role WHERE status = '1')""")
def _(v):
    new = v.lineitem.filter("l_returnflag = 'R'").select(
        F.col("l_suppkey").alias("role_id"), F.col("l_partkey").alias("menu_id")).distinct()
    return U.replace_children(v.role_menu, "role_id", v.role.filter("status = '1'").select("id"), new)


# --- maintenance --------------------------------------------------------------

@query("backfill", "SELECT id, CASE WHEN dept IS NULL OR dept = 0 THEN 1 ELSE dept END AS dept FROM (SELECT id, CASE WHEN segment = 'BUILDING' THEN NULL ELSE dept_id END AS dept FROM v_user)")
def _(v):
    rows = v.user.select("id", F.when(F.col("segment") != "BUILDING", F.col("dept_id")).alias("dept"))
    return U.backfill(rows, "dept", 1)


_ENDS = """e AS (SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'FURNITURE' THEN '1' ELSE '0' END AS status,
    CASE WHEN c_mktsegment <> 'BUILDING' THEN TIMESTAMP '2024-05-20' + INTERVAL 1 HOUR * CAST(floor(c_acctbal / 5) AS INT) END AS end_time FROM customer)"""


@query("expire", f"""WITH {_ENDS} SELECT id, CASE WHEN status = '0' AND end_time <= TIMESTAMP '{NOW}' THEN '1' ELSE status END AS status,
    CASE WHEN status = '1' OR end_time IS NULL OR end_time <= TIMESTAMP '{NOW}' THEN NULL
        WHEN end_time <= TIMESTAMP '{NOW}' + INTERVAL 1 DAY THEN 1 WHEN end_time <= TIMESTAMP '{NOW}' + INTERVAL 7 DAY THEN 7
        WHEN end_time <= TIMESTAMP '{NOW}' + INTERVAL 30 DAY THEN 30 END AS notice_days FROM e""")
def _(v):
    hours = F.make_dt_interval(hours=F.floor(F.col("c_acctbal") / 5).cast("int"))
    end = F.when(F.col("c_mktsegment") != "BUILDING", F.lit("2024-05-20 00:00:00").cast("timestamp_ntz") + hours)
    rows = v.customer.select(F.col("c_custkey").alias("id"),
                             F.when(F.col("c_mktsegment") == "FURNITURE", "1").otherwise("0").alias("status"),
                             end.alias("end_time"))
    return U.expire(rows, NOW).select("id", "status", "notice_days")


@query("retain", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def _(v):
    return U.retain(v.events, "ts", 7, "2024-01-31 00:00:00").select("event_id")


@query("rename_propagate", """SELECT p_partkey, CASE WHEN p_type IN ('PROMO', 'LARGE') THEN 'new_' || lower(p_type) ELSE p_type END AS p_type,
    CASE p_type WHEN 'PROMO' THEN '1' WHEN 'LARGE' THEN '0' ELSE p_brand END AS status FROM part""")
def _(v):
    kinds = v.part.filter(F.col("p_type").isin("PROMO", "LARGE")).select("p_type").distinct()
    renames = kinds.select(F.col("p_type").alias("old"), F.concat(F.lit("new_"), F.lower("p_type")).alias("new"),
                           F.when(F.col("p_type") == "PROMO", "1").otherwise("0").alias("status"))
    child = v.part.withColumn("status", F.col("p_brand"))
    return U.rename_propagate(child, renames, "p_type", "status").select("p_partkey", "p_type", "status")


@query("cancel_pending", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'cancelled' ELSE event_type END AS status FROM events")
def _(v):
    status = F.when(F.col("event_type") == "view", "pending").otherwise(F.col("event_type"))
    return U.cancel_pending(v.events.select("event_id", status.alias("status")))


def _guarded(v: Views):
    rules = [(F.col("is_superuser"), "superuser"), (F.col("status") == "0", "enabled"), (F.col("id") == 7, "self")]
    ids = v.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return U.guarded_delete(v.user, ids, rules, TableSpec("user"), CTX)


_WANT = "id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"


@query("guarded_delete", f"SELECT id, name FROM v_user WHERE NOT ({_WANT}) OR tenant_id <> 2 OR is_superuser OR status = '0' OR id = 7")
def _(v):
    return _guarded(v)[0].select("id", "name")


@query("guarded_delete_rejects", f"""SELECT id, CASE WHEN tenant_id <> 2 THEN 'foreign_tenant' WHEN is_superuser THEN 'superuser' WHEN status = '0' THEN 'enabled' ELSE 'self' END AS reason
    FROM v_user WHERE {_WANT} AND (tenant_id <> 2 OR is_superuser OR status = '0' OR id = 7)""")
def _(v):
    return _guarded(v)[1]
