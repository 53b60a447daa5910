"""Hierarchies and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegov.operators import dag as G
from tablegov.operators import tree as H
from tablegov.plans.registry import query

_DOWN = """WITH RECURSIVE d AS (SELECT id AS root_id, id, 0 AS depth FROM v_org WHERE {seed} UNION ALL
    SELECT d.root_id, o.id, d.depth + 1 FROM v_org o JOIN d ON o.parent_id = d.id) """
_UP = """WITH RECURSIVE d AS (SELECT id AS root_id, id, parent_id, 0 AS depth FROM v_org WHERE {seed} UNION ALL
    SELECT d.root_id, o.id, o.parent_id, d.depth + 1 FROM v_org o JOIN d ON o.id = d.parent_id) """

_ASIA_AND_3 = "id IN ('R2', 'N3')"
_PENDING = "id LIKE 'O%' AND name = '1-URGENT'"


@query("dept_descendants", _DOWN.format(seed=_ASIA_AND_3) + "SELECT root_id, id, depth FROM d")
def _(v):
    return H.descendants(v.org, v.org.filter(_ASIA_AND_3).select("id"))


@query("dept_ancestors", _UP.format(seed=_PENDING) + "SELECT root_id, id, depth FROM d")
def _(v):
    return H.ancestors(v.org, v.org.filter(_PENDING).select("id"))


@query("self_references", "SELECT conv_id, turn FROM conversations WHERE conv_id = turn")
def _(v):
    return H.self_references(v.conversations, "conv_id", "turn").select("conv_id", "turn")


@query("cascade_enable", _UP.format(seed="id LIKE 'C%' AND status = '1'")
       + "SELECT id, CASE WHEN id IN (SELECT id FROM d) THEN '0' ELSE status END AS status FROM v_org")
def _(v):
    return H.cascade_enable(v.org, v.org.filter("id like 'C%' and status = '1'").select("id")).select("id", "status")


@query("cascade_disable", _DOWN.format(seed="id LIKE 'N%' AND status = '1'")
       + "SELECT id, CASE WHEN id IN (SELECT id FROM d) THEN '1' ELSE status END AS status FROM v_org")
def _(v):
    return H.cascade_disable(v.org, v.org.filter("id like 'N%' and status = '1'").select("id")).select("id", "status")


@query("cascade_delete", _DOWN.format(seed="id LIKE 'C%' AND status = '1'")
       + "SELECT id, name FROM v_org WHERE id NOT IN (SELECT id FROM d)")
def _(v):
    return H.cascade_delete(v.org, v.org.filter("id like 'C%' and status = '1'").select("id")).select("id", "name")


_PATHS = """WITH RECURSIVE t AS (SELECT id, parent_id, id AS root_id, 0 AS level, id AS path FROM v_menutree
        WHERE parent_id IS NULL {orphans}
    UNION ALL SELECT m.id, m.parent_id, t.root_id, t.level + 1, t.path || '>' || m.id FROM v_menutree m JOIN t ON m.parent_id = t.id)
    SELECT id, parent_id, root_id, level, path, id NOT IN (SELECT parent_id FROM v_menutree WHERE parent_id IS NOT NULL) AS is_leaf FROM t"""


@query("tree_paths", _PATHS.format(orphans="OR parent_id NOT IN (SELECT id FROM v_menutree)"))
def _(v):
    return H.tree_paths(v.menutree).withColumn("path", F.array_join("path", ">"))


@query("tree_paths_drop", _PATHS.format(orphans=""))
def _(v):
    return H.tree_paths(v.menutree, orphans="drop").withColumn("path", F.array_join("path", ">"))


@query("tree_unreachable", "SELECT id FROM v_menutree WHERE starts_with(parent_id, 'gone/')")
def _(v):
    return H.unreachable(v.menutree, H.tree_paths(v.menutree, orphans="drop")).select("id")


@query("tree_options", """WITH RECURSIVE t AS (SELECT id, name, status, parent_id, 0 AS level FROM v_org WHERE parent_id IS NULL
    UNION ALL SELECT o.id, o.name, o.status, o.parent_id, t.level + 1 FROM v_org o JOIN t ON o.parent_id = t.id)
    SELECT id AS value, name AS label, status = '1' AS disabled, parent_id, level FROM t""")
def _(v):
    nodes = v.org.withColumn("status", F.when(F.col("status") == "1", "false").otherwise("true"))
    return H.tree_options(H.tree_paths(v.org), nodes).drop("path")


@query("expand_with_ancestors", _UP.format(seed=_PENDING) + "SELECT DISTINCT id FROM d")
def _(v):
    return H.expand_with_ancestors(v.org, v.org.filter(_PENDING).select("id"))


@query("linked_check", """SELECT o.parent_id, o.id AS child_id, CASE WHEN p.status = '0' THEN 'child_not_chosen' ELSE 'parent_not_chosen' END AS reason
    FROM v_org o JOIN v_org p ON p.id = o.parent_id WHERE (o.status = '0') <> (p.status = '0')""")
def _(v):
    return H.linked_violations(v.org, v.org.filter("status = '0'").select("id"))


@query("has_selected_descendant", _UP.format(seed="id LIKE 'O%' AND status = '1'") + "SELECT DISTINCT id FROM d")
def _(v):
    return H.has_selected_descendant(v.org, v.org.filter("id like 'O%' and status = '1'").select("id"))


@query("filter_tree", """WITH RECURSIVE t AS (SELECT id FROM v_menutree WHERE type IN (1, 2, 4) AND
        (parent_id IS NULL OR parent_id NOT IN (SELECT id FROM v_menutree))
    UNION ALL SELECT m.id FROM v_menutree m JOIN t ON m.parent_id = t.id WHERE m.type IN (1, 2, 4)) SELECT id FROM t""")
def _(v):
    return H.filter_tree(v.menutree, [1, 2, 4]).select("id")


@query("tree_audit", """WITH j AS (SELECT m.id, m.parent_id, m.type, coalesce(nullif(m.client, ''), 'pc') AS client, p.id AS pid,
        p.type AS ptype, coalesce(nullif(p.client, ''), 'pc') AS pclient FROM v_menutree m LEFT JOIN v_menutree p ON p.id = m.parent_id)
    SELECT id, parent_id, 'top_level_type' AS reason FROM j WHERE parent_id IS NULL AND type NOT IN (1, 2, 4)
    UNION ALL SELECT id, parent_id, 'parent_missing' FROM j WHERE parent_id IS NOT NULL AND pid IS NULL
    UNION ALL SELECT id, parent_id, 'directory_child_type' FROM j WHERE ptype = 1 AND type NOT IN (1, 2, 4)
    UNION ALL SELECT id, parent_id, 'menu_child_type' FROM j WHERE ptype = 2 AND type <> 3
    UNION ALL SELECT id, parent_id, 'child_below_leaf' FROM j WHERE ptype IN (3, 4)
    UNION ALL SELECT id, parent_id, 'client_differs' FROM j WHERE pid IS NOT NULL AND pclient <> client""")
def _(v):
    return H.tree_audit(v.menutree)


@query("dag_levels", """WITH RECURSIVE w AS (SELECT id, 0 AS level FROM v_node WHERE id NOT IN (SELECT target FROM v_edge) UNION
    SELECT e.target, w.level + 1 FROM w JOIN v_edge e ON e.source = w.id)
    SELECT id, max(level) AS level FROM w GROUP BY id""")
def _(v):
    return G.dag_levels(v.node, v.edge)


_BROKEN = """b AS (SELECT source, target FROM v_edge UNION ALL SELECT target, source FROM v_edge WHERE source = 'R2'
    UNION ALL SELECT id, 'X' || status FROM v_org WHERE id LIKE 'C%')"""


@query("dag_violations", f"""WITH RECURSIVE {_BROKEN}, w AS (SELECT 'R2' AS id UNION SELECT b.target FROM b JOIN w ON w.id = b.source)
    SELECT 'unknown_node' AS reason, target AS item FROM (SELECT DISTINCT target FROM b WHERE target NOT IN (SELECT id FROM v_node))
    UNION ALL SELECT 'cycle', id FROM w WHERE id IN (SELECT id FROM v_node)""")
def _(v):
    edges = v.edge
    back = v.nation.filter("n_regionkey = 2").select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("source"), F.lit("R2").alias("target"))
    loose = v.user.select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("source"),
                          F.concat(F.lit("X"), "status").alias("target"))
    return G.dag_violations(v.node, edges.unionByName(back).unionByName(loose))


@query("upstream", "SELECT DISTINCT target AS id, source AS input FROM v_edge WHERE source IN (SELECT id FROM v_node)")
def _(v):
    return G.upstream(v.node, v.edge)


def _filter_node(inputs, args, kwargs, variables):
    (df,) = inputs.values()
    return df.filter(F.col(args[0]) > float(kwargs.get("above", variables["floor"])))


def _sum_node(inputs, args, kwargs, variables):
    (df,) = inputs.values()
    return df.groupBy(*args).agg(F.sum(F.col(kwargs["of"]).cast("decimal(18,2)")).cast("double").alias("total"))


def _join_node(inputs, args, kwargs, variables):
    left, right = inputs["by_status"], inputs["by_priority"]
    return left.select(F.lit("status").alias("kind"), F.col("status").alias("label"), "total").unionByName(
        right.select(F.lit("priority").alias("kind"), F.col("priority").alias("label"), "total"))


@query("compose", """SELECT 'status' AS kind, status AS label, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total FROM v_order
    WHERE amount > 250000 GROUP BY status UNION ALL
    SELECT 'priority', priority, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) FROM v_order WHERE amount > 250000 GROUP BY priority""")
def _(v):
    reg = G.Registry()
    reg.register("orders", lambda inputs, args, kwargs, variables: v.order)
    reg.register("filter", _filter_node, "amount")
    reg.register("sum", _sum_node, kwargs='{"of": "amount"}')
    reg.register("merge", _join_node)
    nodes = [{"id": "merge", "type": "merge"}, {"id": "by_status", "type": "sum", "data": {"args": "status"}},
             {"id": "by_priority", "type": "sum", "data": {"args": "priority, "}}, {"id": "big", "type": "filter"},
             {"id": "all", "type": "orders"}]
    edges = [{"source": a, "target": b} for a, b in [
        ("all", "big"), ("big", "by_status"), ("big", "by_priority"), ("by_status", "merge"), ("by_priority", "merge")]]
    return G.compose(nodes, edges, reg, {"floor": 250000})["merge"]
