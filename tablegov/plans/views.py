"""The business roles played by the driver's tables, once for Spark and once as
SQL text for the comparison."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

# Declared schemas spare the footer inference at every read.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

_IP = ("CASE event_type WHEN 'view' THEN '10.0.' WHEN 'click' THEN '192.168.' WHEN 'signup' THEN '172.20.' "
       "WHEN 'purchase' THEN '8.8.' ELSE '203.0.' END")

# Every view is a plain select, so most texts serve both engines.
_BOTH = {
    "v_tenant": "SELECT r_regionkey AS id, r_name AS name, CASE WHEN r_name = 'EUROPE' THEN '1' ELSE '0' END AS status, "
                "r_regionkey AS sort, false AS is_deleted FROM region",
    "v_dept": "SELECT n_nationkey AS id, 1000 + n_regionkey AS parent_id, n_name AS name, n_regionkey AS tenant_id, "
              "'0' AS status FROM nation UNION ALL "
              "SELECT 1000 + r_regionkey, 9999, r_name, r_regionkey, '0' FROM region UNION ALL "
              "SELECT 9999, CAST(NULL AS INT), 'HEAD OFFICE', CAST(NULL AS INT), '0'",
    "v_user": "SELECT c_custkey AS id, c_name AS name, c_nationkey AS dept_id, n_regionkey AS tenant_id, "
              "CASE WHEN c_mktsegment = 'FURNITURE' THEN '1' ELSE '0' END AS status, "
              "c_mktsegment = 'MACHINERY' AND c_acctbal > 9000 AS is_superuser, c_acctbal AS balance, "
              "c_mktsegment AS segment FROM customer JOIN nation ON n_nationkey = c_nationkey",
    "v_order": "SELECT o_orderkey AS id, o_custkey AS created_id, o_orderdate AS created_time, "
               "CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate + INTERVAL 1 DAY "
               "ELSE o_orderdate + INTERVAL 5 DAY END AS updated_time, o_custkey AS updated_id, "
               "o_orderstatus AS status, o_totalprice AS amount, o_orderpriority AS priority, "
               "o_orderpriority = '4-NOT SPECIFIED' AS is_deleted, "
               "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN o_orderdate + INTERVAL 10 DAY END AS deleted_time, "
               "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN o_custkey END AS deleted_id, "
               "CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority || ' order' END AS description FROM orders",
    "v_torder": "SELECT o.*, u.tenant_id FROM v_order o JOIN v_user u ON u.id = o.created_id",
    "v_role": "SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_acctbal < 1000 THEN '1' ELSE '0' END AS status "
              "FROM supplier",
    "v_menu": "SELECT p_partkey AS id, p_name AS name, CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'PROMO' THEN 1 "
              "WHEN 'SMALL' THEN 2 WHEN 'STANDARD' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END AS type, "
              "CASE WHEN p_type = 'PROMO' THEN '1' ELSE '0' END AS status, "
              "CASE WHEN p_brand = 'Brand#5' THEN 'app' ELSE 'pc' END AS client, "
              "p_brand || ':' || lower(p_type) AS permission, p_size AS sort FROM part",
    "v_role_menu": "SELECT DISTINCT l_suppkey AS role_id, l_partkey AS menu_id FROM lineitem",
    "v_user_role": "SELECT DISTINCT o_custkey AS user_id, l_suppkey AS role_id FROM lineitem "
                   "JOIN orders ON o_orderkey = l_orderkey",
    "v_link": "SELECT o_custkey AS user_id, n_regionkey AS tenant_id, min(l_orderkey) AS id, "
              "bool_or(l_returnflag = 'R') AND bool_and(l_linestatus = 'O') AS is_default, max(l_discount) >= 0.1 AS is_owner "
              "FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey "
              "JOIN nation ON n_nationkey = s_nationkey GROUP BY o_custkey, n_regionkey",
    "v_job_event": "SELECT event_id, user_id AS job_id, ts, CASE event_type WHEN 'signup' THEN 'submitted' "
                   "WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'removed' ELSE 'executed' END AS kind FROM events",
    "v_session_event": "SELECT event_id, user_id AS session_id, ts, CASE event_type WHEN 'purchase' THEN 'logout' "
                       "ELSE 'login' END AS kind FROM events WHERE event_type IN ('signup', 'purchase')",
    "v_menutree": "SELECT DISTINCT p_brand AS id, CAST(NULL AS STRING) AS parent_id, p_brand AS name, 1 AS type, "
                  "'pc' AS client, CASE WHEN p_brand = 'Brand#9' THEN '1' ELSE '0' END AS status FROM part UNION ALL "
                  "SELECT DISTINCT p_brand || '/' || p_type, p_brand, p_type, 2, "
                  "CASE WHEN p_type = 'LARGE' AND p_brand = 'Brand#3' THEN 'app' ELSE 'pc' END, "
                  "CASE WHEN p_type = 'PROMO' THEN '1' ELSE '0' END FROM part UNION ALL "
                  "SELECT 'P' || CAST(p_partkey AS STRING), "
                  "CASE WHEN p_size = 50 THEN 'gone/' || p_type ELSE p_brand || '/' || p_type END, p_name, "
                  "CASE WHEN p_size > 45 THEN 4 ELSE 3 END, CASE WHEN p_size < 3 THEN 'app' ELSE '' END, "
                  "CASE WHEN p_retailprice > 1000 THEN '1' ELSE '0' END FROM part",
    "v_org": "SELECT 'R' || CAST(r_regionkey AS STRING) AS id, CAST(NULL AS STRING) AS parent_id, r_name AS name, "
             "CASE WHEN r_name = 'ASIA' THEN '1' ELSE '0' END AS status FROM region UNION ALL "
             "SELECT 'N' || CAST(n_nationkey AS STRING), 'R' || CAST(n_regionkey AS STRING), n_name, "
             "CASE WHEN n_name = 'NATION_3' THEN '1' ELSE '0' END FROM nation UNION ALL "
             "SELECT 'C' || CAST(c_custkey AS STRING), 'N' || CAST(c_nationkey AS STRING), c_name, "
             "CASE WHEN c_mktsegment = 'FURNITURE' THEN '1' ELSE '0' END FROM customer UNION ALL "
             "SELECT 'O' || CAST(o_orderkey AS STRING), 'C' || CAST(o_custkey AS STRING), o_orderpriority, "
             "CASE WHEN o_orderstatus = 'P' THEN '1' ELSE '0' END FROM orders",
    "v_node": "SELECT id FROM v_org UNION ALL SELECT 'P' || CAST(p_partkey AS STRING) FROM part",
    "v_edge": "SELECT parent_id AS source, id AS target FROM v_org WHERE parent_id IS NOT NULL UNION ALL "
              "SELECT 'O' || CAST(l_orderkey AS STRING), 'P' || CAST(l_partkey AS STRING) FROM lineitem",
}

_SQL_ONLY = {
    "v_log": f"""SELECT event_id AS id, CAST(event_id AS STRING) AS uuid, user_id, ts, ts AS created_time, event_type AS handler,
        CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'GET' WHEN 'error' THEN 'PUT' ELSE 'POST' END AS method,
        '/' || event_type AS path,
        CASE WHEN event_type = 'error' THEN 500 WHEN value > 150 THEN 404 WHEN event_type = 'signup' THEN 302 ELSE 200 END AS code,
        value AS latency, printf('%.2fs', value) AS process_time, props AS request_payload,
        {_IP} || CAST(user_id % 256 AS STRING) || '.' || CAST((user_id // 256) % 256 AS STRING) AS peer,
        CASE event_type WHEN 'click' THEN {_IP} || CAST(user_id % 256 AS STRING) || '.1, 172.16.0.1' WHEN 'view' THEN '' END AS forwarded,
        CASE WHEN value > 40 THEN 'http://host/docs' WHEN event_type = 'signup' THEN 'http://host/redoc' END AS referer
        FROM events""",
    "v_file": """SELECT p_brand || '/' || CASE WHEN p_type = 'SMALL' THEN '.' ELSE '' END || p_type || '/' ||
        CASE WHEN p_size > 45 THEN '.' ELSE '' END || replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS STRING) || '.Dat' AS path,
        CAST(floor(p_retailprice * p_size) AS BIGINT) AS size FROM part""",
}

VIEW_SQL = {**{k: v.replace("AS STRING", "AS VARCHAR") for k, v in _BOTH.items()},
            **{k: v.replace("AS STRING", "AS VARCHAR") for k, v in _SQL_ONLY.items()}}

_SPARK = {
    **_BOTH,
    "v_log": _SQL_ONLY["v_log"].replace(" // ", " div "),
    "v_file": _SQL_ONLY["v_file"],
}


class Views:
    """Tables and views of one data directory as lazy frames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        """A ``v_`` view; the tables and views in its text are passed as
        DataFrame arguments of the SQL, nothing is registered in the session."""
        text = _SPARK[name]
        args = {}
        for used in [t for t in [*SCHEMAS, *_SPARK] if t != name]:
            marked = _name_pattern(used).sub("{" + used + "}", text)
            if marked != text:
                text = marked
                args[used] = self.view(used) if used in _SPARK else self.table(used)
        return self.spark.sql(text, **args)

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return self.table(name)
        if f"v_{name}" in _SPARK:
            return self.view(f"v_{name}")
        raise AttributeError(name)


def _name_pattern(name: str):
    import re

    return re.compile(rf"(?<=FROM )\b{name}\b|(?<=JOIN )\b{name}\b")
