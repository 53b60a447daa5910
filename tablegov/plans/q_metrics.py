"""Aggregates, windows, audits, logs and their batch twins of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegov.functions.text import fmt_ts
from tablegov.operators import jobs as J
from tablegov.operators import metrics as M
from tablegov.operators import mutate as U
from tablegov.operators import quality as Q
from tablegov.plans.registry import query
from tablegov.streaming.streams import audit_rows

# --- guards and audits --------------------------------------------------------


@query("owner_guard", """SELECT tenant_id, count_if(is_owner AND NOT gone) AS owners_left, count_if(is_owner AND gone) AS owners_removed
    FROM (SELECT l.*, user_id IN (SELECT id FROM v_user WHERE status = '0') AS gone FROM v_link l)
    GROUP BY tenant_id HAVING count_if(is_owner AND NOT gone) < 1 AND count_if(is_owner AND gone) > 0""")
def _(v):
    gone = v.link.join(v.user.filter("status = '0'").select(F.col("id").alias("user_id")), "user_id", "left_semi")
    return U.last_owner_guard(v.link, gone.select("tenant_id", "user_id"))


@query("owner_guard_by_user", """SELECT user_id, count_if(is_owner AND NOT is_default) AS owners_left,
    count_if(is_owner AND is_default) AS owners_removed FROM v_link GROUP BY user_id
    HAVING count_if(is_owner AND NOT is_default) < 1 AND count_if(is_owner AND is_default) > 0""")
def _(v):
    # Roles swapped: each user's accounts need one owning tenant.
    return U.last_owner_guard(v.link, v.link.filter("is_default").select("user_id", "tenant_id"),
                              tenant="user_id", user="tenant_id")


@query("unique_audit", "SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def _(v):
    return Q.unique_audit(v.part, ["p_brand", "p_name"])


@query("unique_audit_lines", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(v):
    return Q.unique_audit(v.lineitem, ["l_orderkey", "l_linenumber"])


_NUMBERED = "(SELECT *, row_number() OVER (ORDER BY created_time, id) AS row_no FROM v_order)"


@query("null_report", f"""SELECT field, count(*) AS n, min(row_no) AS first_row, max(row_no) AS last_row FROM (
    SELECT 'description' AS field, row_no FROM {_NUMBERED} WHERE description IS NULL
    UNION ALL SELECT 'deleted_time', row_no FROM {_NUMBERED} WHERE deleted_time IS NULL) GROUP BY field""")
def _(v):
    rows = Q.with_row_no(v.order, ["created_time", "id"])
    return Q.null_report(rows, ["description", "deleted_time", "status"])


@query("null_rows", f"SELECT 'description' AS field, row_no FROM {_NUMBERED} WHERE description IS NULL")
def _(v):
    return Q.null_rows(Q.with_row_no(v.order, ["created_time", "id"]), ["description", "status"])


@query("row_index", "SELECT id, row_number() OVER (ORDER BY amount DESC, id) AS row_no FROM v_order")
def _(v):
    return M.row_index(v.order.select("id", "amount"), [("amount", "desc"), ("id", "asc")]).select("id", "row_no")


# --- messages and sessions ----------------------------------------------------

@query("message_stats", """SELECT conv_id, count_if(role <> '') AS message_count, count_if(role = 'user') AS user_messages,
    CAST(sum(length(text)) AS BIGINT) AS characters FROM conversations GROUP BY conv_id""")
def _(v):
    return M.message_stats(v.conversations, "conv_id", "role", "text")


@query("session_buckets", """SELECT CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 'today' WHEN ts >= TIMESTAMP '2024-01-19' THEN 'yesterday'
    WHEN ts >= TIMESTAMP '2024-01-13' THEN 'week' ELSE 'earlier' END AS bucket, count(*) AS n, count(DISTINCT user_id) AS users
    FROM events WHERE ts < TIMESTAMP '2024-01-20 15:30:00' GROUP BY 1""")
def _(v):
    now = "2024-01-20 15:30:00"
    rows = M.session_buckets(v.events.filter(F.col("ts") < F.lit(now).cast("timestamp_ntz")), "ts", now)
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("active_sessions", """SELECT session_id, strftime(login_time, '%Y-%m-%d %H:%M:%S') AS login_time FROM (
    SELECT session_id, max(ts) AS login_time, arg_max(kind, (ts, event_id)) AS kind FROM v_session_event
    WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY session_id)
    WHERE kind = 'login' AND login_time + INTERVAL 86400 SECOND > TIMESTAMP '2024-01-20'""")
def _(v):
    return J.active_sessions(v.session_event, 86400, "2024-01-20 00:00:00").select(
        "session_id", fmt_ts(F.col("login_time")).alias("login_time"))


# --- requests -----------------------------------------------------------------

@query("request_metrics", """SELECT method, path AS handler, CAST(code // 100 AS VARCHAR) || 'xx' AS status, count(*) AS requests,
    CAST(sum(CAST(latency / 1000 AS DECIMAL(18,6))) AS DOUBLE) AS latency_sum, count_if(latency / 1000 <= 0.001) AS le_0_001,
    count_if(latency / 1000 <= 0.005) AS le_0_005, count_if(latency / 1000 <= 0.05) AS le_0_05, CAST(sum(length(request_payload)) AS BIGINT) AS size_sum
    FROM v_log WHERE path <> '/view' GROUP BY 1, 2, 3""")
def _(v):
    log = v.log.withColumn("size", F.length("request_payload")).withColumn("latency", F.col("latency") / 1000)
    return M.request_metrics(log, [0.001, 0.005, 0.05], request_size="size", excluded=["/view", "/static/.*"])


@query("service_level", """SELECT handler, round(count(*) / 2592000.0, 8) AS qps, round(avg(CASE WHEN code >= 500 THEN 1.0 ELSE 0 END), 6) AS error_rate,
    round(quantile_cont(latency, 0.99), 6) AS p99 FROM v_log GROUP BY handler""")
def _(v):
    out = M.service_level(v.log, 2592000.0, by=["handler"], exact=True)
    return out.select("handler", F.round("qps", 8).alias("qps"), F.round("error_rate", 6).alias("error_rate"),
                      F.round("p99", 6).alias("p99"))


@query("service_level_ranged", """SELECT code // 100 AS class, round(quantile_cont(latency, 0.99), 6) AS p99, round(quantile_cont(latency, 0.5), 6) AS p50
    FROM (SELECT code, floor(latency) AS latency FROM v_log) GROUP BY 1""")
def _(v):
    log = v.log.select(F.floor(F.col("code") / 100).alias("class"), F.floor("latency").cast("double").alias("latency"))
    high, middle = (M.exact_percentile(log, "latency", p, ["class"], f"p{round(p * 100)}", small_rows=0) for p in (0.99, 0.5))
    return high.join(middle, "class").select("class", F.round("p99", 6).alias("p99"), F.round("p50", 6).alias("p50"))


@query("service_level_approx", None)
def _(v):
    return M.service_level(v.log, 2592000.0, by=["handler"])


@query("rate_limit", """SELECT user_id AS client, strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS calls
    FROM events GROUP BY 1, 2 HAVING count(*) > 3""")
def _(v):
    return J.rate_limit(v.events, 3, "6 hours", client="user_id").select(
        "client", fmt_ts(F.col("window_start")).alias("window_start"), "calls")


@query("rate_limit_sliding", """SELECT user_id AS client, strftime(time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 2 HOUR * k, '%Y-%m-%d %H:%M:%S') AS window_start,
    count(*) AS calls FROM events, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1, 2 HAVING count(*) > 3""")
def _(v):
    return J.rate_limit(v.events, 3, "6 hours", "2 hours", client="user_id").select(
        "client", fmt_ts(F.col("window_start")).alias("window_start"), "calls")


@query("audit_rows", """SELECT id, CASE WHEN coalesce(forwarded, '') <> '' THEN trim(split_part(forwarded, ',', 1)) ELSE peer END AS request_ip,
    CASE WHEN event IN ('signup') THEN '内网IP' ELSE '未解析(已关闭归属地查询)' END AS login_location, seconds, request_payload
    FROM (SELECT *, handler AS event, CAST(rtrim(process_time, 's') AS DOUBLE) AS seconds FROM v_log
        WHERE method IN ('POST', 'PUT') AND NOT (coalesce(referer, '') LIKE '%docs' OR coalesce(referer, '') LIKE '%redoc'))""")
def _(v):
    return audit_rows(v.log).select("id", "request_ip", "login_location", "seconds", "request_payload")


# --- jobs ---------------------------------------------------------------------

_RUNS = """WITH e AS (SELECT *, CASE WHEN kind = 'submitted' THEN 1 ELSE -1 END AS x FROM v_job_event),
    s AS (SELECT *, sum(x) OVER w AS total FROM e WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
    m AS (SELECT *, total - least(0, min(total) OVER w) AS depth,
        total - x - least(0, coalesce(min(total) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS before
        FROM s WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
    l AS (SELECT *, CASE WHEN x = 1 THEN depth ELSE before END AS lvl FROM m WHERE x = 1 OR before > 0),
    k AS (SELECT *, lead(event_id) OVER (PARTITION BY job_id, lvl ORDER BY ts, event_id) AS close_id,
        lead(kind) OVER (PARTITION BY job_id, lvl ORDER BY ts, event_id) AS close_kind,
        lead(ts) OVER (PARTITION BY job_id, lvl ORDER BY ts, event_id) AS close_ts FROM l),
    runs AS (SELECT event_id AS run_id, job_id, ts AS started, close_kind, close_ts FROM k WHERE x = 1),
    e2 AS (SELECT run_id AS event_id, job_id, started AS ts, 1 AS x, 'open' AS kind FROM runs WHERE close_kind = 'removed'
        UNION ALL SELECT event_id, job_id, ts, -1, kind FROM m WHERE x = -1 AND before = 0 AND kind <> 'removed'),
    s2 AS (SELECT *, sum(x) OVER w AS total FROM e2 WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
    m2 AS (SELECT *, total - least(0, min(total) OVER w) AS depth,
        total - x - least(0, coalesce(min(total) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS before
        FROM s2 WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
    k2 AS (SELECT *, lead(kind) OVER w AS late_kind, lead(ts) OVER w AS late_ts
        FROM (SELECT *, CASE WHEN x = 1 THEN depth ELSE before END AS lvl FROM m2 WHERE x = 1 OR before > 0)
        WINDOW w AS (PARTITION BY job_id, lvl ORDER BY ts, event_id)),
    done AS (SELECT r.run_id, r.job_id, r.started, coalesce(k2.late_kind, r.close_kind) AS kind, coalesce(k2.late_ts, r.close_ts) AS ended
        FROM runs r LEFT JOIN k2 ON k2.event_id = r.run_id AND k2.x = 1
        UNION ALL SELECT event_id, job_id, ts, kind, ts FROM m2 WHERE x = -1 AND before = 0)
    """
_STATUS = ("CASE kind WHEN 'executed' THEN 'success' WHEN 'error' THEN 'failed' WHEN 'removed' THEN 'cancelled' "
           "ELSE 'running' END AS status")


@query("job_runs", _RUNS + f"SELECT run_id, job_id, {_STATUS}, strftime(started, '%Y-%m-%d %H:%M:%S') AS started, "
       "strftime(ended, '%Y-%m-%d %H:%M:%S') AS ended FROM done")
def _(v):
    return J.job_runs(v.job_event).select("run_id", "job_id", "status", fmt_ts(F.col("started")).alias("started"),
                                          fmt_ts(F.col("ended")).alias("ended"))


@query("job_status_summary", "SELECT kind AS status, count(*) AS runs, count(DISTINCT job_id) AS jobs FROM v_job_event GROUP BY kind")
def _(v):
    return M.job_status_summary(v.job_event.withColumnRenamed("kind", "status"))


# --- files --------------------------------------------------------------------

@query("path_totals", """WITH f AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, size FROM v_file),
    d AS (SELECT DISTINCT dir FROM f UNION SELECT DISTINCT split_part(dir, '/', 1) FROM f UNION SELECT '')
    SELECT d.dir, (SELECT count(*) FROM f WHERE f.dir = d.dir) AS files,
        (SELECT count(*) FROM d s WHERE s.dir <> '' AND regexp_extract('/' || s.dir, '^(.*)/[^/]*$', 1) = CASE WHEN d.dir = '' THEN '' ELSE '/' || d.dir END) AS dirs,
        CAST(coalesce((SELECT sum(size) FROM f WHERE f.dir = d.dir), 0) AS BIGINT) AS size FROM d""")
def _(v):
    return M.dir_totals(v.file)


@query("path_tree_totals", """WITH f AS (SELECT split_part(path, '/', 1) AS a, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS b, size FROM v_file)
    SELECT '' AS dir, count(*) AS files, count(DISTINCT a) + count(DISTINCT b) AS dirs, CAST(sum(size) AS BIGINT) AS size FROM f
    UNION ALL SELECT a, count(*), count(DISTINCT b), CAST(sum(size) AS BIGINT) FROM f GROUP BY a
    UNION ALL SELECT b, count(*), 0, CAST(sum(size) AS BIGINT) FROM f GROUP BY b""")
def _(v):
    return M.tree_totals(v.file)


# --- quotas -------------------------------------------------------------------

@query("quota_usage", """WITH used AS (SELECT tenant_id, 'users' AS resource, CAST(count(*) AS DOUBLE) AS used FROM v_user GROUP BY 1
    UNION ALL SELECT tenant_id, 'depts', count(*) FROM v_dept WHERE tenant_id IS NOT NULL GROUP BY 1
    UNION ALL SELECT tenant_id, 'amount', CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) FROM v_torder GROUP BY 1),
    q AS (SELECT id AS tenant_id, resource, CASE resource WHEN 'users' THEN 300 WHEN 'depts' THEN 50 ELSE 500000000 + id * 100000000 END AS max_value
        FROM v_tenant, (SELECT unnest(['users', 'depts', 'amount', 'roles']) AS resource))
    SELECT q.tenant_id, q.resource, q.max_value, coalesce(used, 0) AS used, coalesce(used, 0) > q.max_value AS over_quota
    FROM q LEFT JOIN used u ON u.tenant_id = q.tenant_id AND u.resource = q.resource""")
def _(v):
    kinds = F.explode(F.array(*[F.lit(k) for k in ("users", "depts", "amount", "roles")])).alias("resource")
    limit = F.when(F.col("resource") == "users", 300).when(F.col("resource") == "depts", 50).otherwise(
        500_000_000 + F.col("tenant_id") * 100_000_000)
    quotas = v.tenant.select(F.col("id").alias("tenant_id"), kinds).withColumn("max_value", limit)
    one = F.count(F.lit(1))
    return M.quota_usage(v.tenant, quotas, {
        "users": (v.user, one), "depts": (v.dept, one), "amount": (v.torder, M.money_sum("amount"))})


# --- dashboards ---------------------------------------------------------------

@query("funnel", """WITH c AS (SELECT count_if(event_type = 'view') AS a, count_if(event_type IN ('click', 'purchase') AND value > 10) AS b,
    count_if(event_type = 'purchase' AND value > 50) AS c FROM events)
    SELECT 1 AS step_no, 'view' AS step, a AS n, 100.0 AS rate FROM c UNION ALL SELECT 2, 'click', b, round(100.0 * b / a) FROM c
    UNION ALL SELECT 3, 'buy', c, round(100.0 * c / a) FROM c""")
def _(v):
    kind, value = F.col("event_type"), F.col("value")
    return M.funnel(v.events, [("view", kind == "view"), ("click", kind.isin("click", "purchase") & (value > 10)),
                               ("buy", (kind == "purchase") & (value > 50))])


@query("pv_uv", """SELECT strftime(time_bucket(INTERVAL 2 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS slot, count(*) AS pv, count(DISTINCT user_id) AS uv
    FROM events GROUP BY 1""")
def _(v):
    return M.pv_uv(v.events, "ts", "user_id").select(fmt_ts(F.col("slot")).alias("slot"), "pv", "uv")


@query("pv_uv_approx", None)
def _(v):
    return M.pv_uv(v.events, "ts", "user_id", approx=True).select(fmt_ts(F.col("slot")).alias("slot"), "pv", "uv")


@query("share", """SELECT segment, value, round(100 * value / sum(value) OVER (), 2) AS percent FROM (
    SELECT segment, CAST(sum(CAST(balance AS DECIMAL(18,2))) AS DOUBLE) AS value FROM v_user GROUP BY segment)""")
def _(v):
    return M.share(v.user, "segment", M.money_sum("balance"))


@query("status_counts", "SELECT status, count(*) AS n FROM v_order GROUP BY status")
def _(v):
    return M.counts_by(v.order, "status")


@query("region_counts", "SELECT t.name AS region, count(*) AS n FROM v_torder o JOIN v_tenant t ON t.id = o.tenant_id GROUP BY 1")
def _(v):
    regions = v.tenant.select(F.col("id").alias("tenant_id"), F.col("name").alias("region"))
    return M.counts_by(v.torder.join(regions, "tenant_id"), "region")


@query("net_sales", """SELECT strftime(l_shipdate, '%Y-%m') AS slot, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS refund,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE) AS actual
    FROM lineitem GROUP BY 1""")
def _(v):
    return M.net_sales(v.lineitem, F.date_format("l_shipdate", "yyyy-MM"), F.col("l_extendedprice"),
                       F.col("l_returnflag") == "R")


@query("rating_mean", "SELECT lang, round(avg(1 + 4 * quality), 3) AS rating FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def _(v):
    rows = v.labels.join(v.documents.select("doc_id", "lang"), "doc_id")
    return M.rating_mean(rows, 1 + 4 * F.col("quality"), ["lang"], 3)


@query("kpi", """SELECT (SELECT CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) FROM v_order) AS total_sales,
    (SELECT count(*) FROM v_order) AS orders, count(DISTINCT user_id) AS active_users,
    round(100.0 * count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) / count(DISTINCT user_id), 2) AS conversion FROM events""")
def _(v):
    return M.kpi(v.order, v.events, bought=F.col("event_type") == "purchase")


@query("new_vs_returning", """WITH s AS (SELECT DISTINCT created_id, date_trunc('month', created_time) AS slot FROM v_order),
    f AS (SELECT created_id, min(slot) AS first FROM s GROUP BY 1)
    SELECT strftime(slot, '%Y-%m-%d') AS slot, count_if(slot = first) AS new_users, count_if(slot > first) AS returning_users
    FROM s JOIN f USING (created_id) GROUP BY 1""")
def _(v):
    return M.new_vs_returning(v.order, "created_id", "created_time", "month").withColumn(
        "slot", F.date_format("slot", "yyyy-MM-dd"))


@query("compare_periods", """SELECT month(created_time) AS slot, round(avg(amount) FILTER (year(created_time) = 1999), 4) AS "1999",
    round(avg(amount) FILTER (year(created_time) = 2000), 4) AS "2000" FROM v_order WHERE year(created_time) IN (1999, 2000) GROUP BY 1""")
def _(v):
    rows = v.order.filter((F.col("created_time") >= F.lit("1999-01-01").cast("timestamp_ntz"))
                          & (F.col("created_time") < F.lit("2001-01-01").cast("timestamp_ntz")))
    return M.compare_periods(rows, F.month("created_time"), F.year("created_time"), F.col("amount"), [1999, 2000])


# --- windows ------------------------------------------------------------------

@query("latest_event", """SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value
    FROM events WHERE event_type = 'error' GROUP BY user_id""")
def _(v):
    return M.latest_per_key(v.events, ["user_id"], "ts", "event_id", F.col("event_type") == "error").select(
        "user_id", "event_id", "value")


@query("default_link", """SELECT id, user_id, tenant_id, is_default OR (NOT bool_or(is_default) OVER (PARTITION BY user_id)
    AND id = min(id) OVER (PARTITION BY user_id)) AS is_default FROM v_link""")
def _(v):
    return U.first_default(v.link).select("id", "user_id", "tenant_id", "is_default")


@query("rank_ratio", """WITH g AS (SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM lineitem GROUP BY 1)
    SELECT l_suppkey, value, rank() OVER (ORDER BY value DESC) AS rank, round(100 * value / max(value) OVER ()) AS ratio
    FROM g ORDER BY value DESC, l_suppkey LIMIT 10""")
def _(v):
    return M.rank_ratio(v.lineitem, "l_suppkey", M.money_sum("l_extendedprice"), 10)


_SLOTS = """WITH s AS (SELECT strftime(created_time, '%Y-%m') AS slot, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS value
    FROM v_order GROUP BY 1) """


def _slots(v):
    return v.order.groupBy(F.date_format("created_time", "yyyy-MM").alias("slot")).agg(M.money_sum("amount").alias("value"))


_FINE = _SLOTS + ", f AS (SELECT slot, value / 1000 AS value FROM s)"


def _fine(v):
    return _slots(v).withColumn("value", F.col("value") / 1000)


@query("growth", _FINE + """SELECT slot, value, round(100 * (value - lag(value) OVER w) / lag(value) OVER w, 2) AS growth,
    CAST(sum(CAST(value AS DECIMAL(28,6))) OVER w AS DOUBLE) AS running_total FROM f WINDOW w AS (ORDER BY slot)""")
def _(v):
    return M.growth(_fine(v), "slot", "value")


@query("target_vs_actual", _FINE + """, t AS (SELECT slot, value, CAST(sum(CAST(value AS DECIMAL(28,6))) OVER w AS DOUBLE) / count(value) OVER w AS target
    FROM f WINDOW w AS (ORDER BY slot ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
    SELECT slot, value, round(target, 2) AS target, round(100 * value / target, 2) AS percent FROM t""")
def _(v):
    return M.target_vs_actual(_fine(v), "slot", "value")
