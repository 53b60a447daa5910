"""Golden selections on a small menu tree, and cycles."""

import pytest
from pyspark.sql import functions as F

from tablegov.operators import dag as G
from tablegov.operators import tree as H
from tablegov.spec import Ctx, TableSpec

# 1 System(dir) > 2 Users(menu) > 3, 4 buttons; 1 > 5 Roles(menu) > 6 button; 7 Tools(dir) > 8 Docs(link)
MENU = [(1, None, 1, "pc"), (2, 1, 2, "pc"), (3, 2, 3, "pc"), (4, 2, 3, "pc"), (5, 1, 2, "pc"), (6, 5, 3, "pc"),
        (7, None, 1, "pc"), (8, 7, 4, None)]


@pytest.fixture(scope="module")
def menu(spark):
    return spark.createDataFrame(MENU, "id int, parent_id int, type int, client string")


def ids_frame(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id int")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_closures(spark, menu, rows):
    assert rows(H.descendants(menu, ids_frame(spark, 1, 5))) == [
        (1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 2), (1, 5, 1), (1, 6, 2), (5, 5, 0), (5, 6, 1)]
    assert rows(H.ancestors(menu, ids_frame(spark, 6))) == [(6, 1, 2), (6, 5, 1), (6, 6, 0)]
    assert rows(H.descendants(menu, ids_frame(spark, 1), max_depth=1)) == [(1, 1, 0), (1, 2, 1), (1, 5, 1)]


def test_selections(spark, menu):
    assert ids(H.expand_with_ancestors(menu, ids_frame(spark, 3, 8))) == [1, 2, 3, 7, 8]
    assert not H.linked_check(menu, ids_frame(spark).limit(0))
    assert H.linked_check(menu, ids_frame(spark, *range(1, 9)))
    assert H.linked_check(menu, ids_frame(spark, 7, 8))
    assert not H.linked_check(menu, ids_frame(spark, 3))
    assert not H.linked_check(menu, ids_frame(spark, 1, 2, 3, 4, 5))
    assert ids(H.has_selected_descendant(menu, ids_frame(spark, 4))) == [1, 2, 4]
    assert ids(H.filter_tree(menu, [1, 2])) == [1, 2, 5, 7]


def test_orphans_and_cycles(spark, rows):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 99), (4, 3), (5, 6), (6, 5), (7, 6), (8, 8)], "id int, parent_id int")
    kept = H.tree_paths(df)
    assert rows(kept.select("id", "root_id", "level")) == [(1, 1, 0), (2, 1, 1), (3, 3, 0), (4, 3, 1)]
    assert rows(H.tree_paths(df, orphans="drop").select("id", "is_leaf")) == [(1, False), (2, True)]
    assert ids(H.unreachable(df, kept)) == [5, 6, 7, 8]
    assert ids(H.self_references(df)) == [8]
    # Walks end on cycles, also on one that does not lead through the start.
    assert rows(H.descendants(df, ids_frame(spark, 5)).select("id", "depth")) == [(5, 0), (6, 1), (7, 2)]
    assert rows(H.ancestors(df, ids_frame(spark, 7)).select("id", "depth")) == [(5, 2), (6, 1), (7, 0)]
    assert ids(H.ancestors(df, ids_frame(spark, 4))) == [3, 4]


def test_cascades(spark):
    df = spark.createDataFrame([(1, None, "1"), (2, 1, "1"), (3, 2, "1"), (4, 1, "0")], "id int, parent_id int, status string")
    on = {r.id: r.status for r in H.cascade_enable(df, ids_frame(spark, 3)).collect()}
    assert on == {1: "0", 2: "0", 3: "0", 4: "0"}
    off = {r.id: r.status for r in H.cascade_disable(df, ids_frame(spark, 1)).collect()}
    assert set(off.values()) == {"1"}
    assert ids(H.cascade_delete(df, ids_frame(spark, 2))) == [1, 4]


def test_audit(spark, rows):
    df = spark.createDataFrame(
        [(1, None, 3, "pc"), (2, 1, 1, "pc"), (3, None, 2, "app"), (4, 3, 2, "app"), (5, 3, 3, "pc"), (6, 77, 1, None),
         (7, None, 1, None), (8, 7, 3, "pc")], "id int, parent_id int, type int, client string")
    assert rows(H.tree_audit(df).select("id", "reason")) == [
        (1, "top_level_type"), (2, "child_below_leaf"), (4, "menu_child_type"), (5, "client_differs"),
        (6, "parent_missing"), (8, "directory_child_type")]


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "source string, target string")


def nodes(spark, text):
    return spark.createDataFrame([(c,) for c in text], "id string")


def test_levels(spark, rows):
    e = edges(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "d"), ("a", "b"))
    assert rows(G.dag_levels(nodes(spark, "abcde"), e)) == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 0)]
    assert G.dag_violations(nodes(spark, "abcde"), e).isEmpty()


def test_violations(spark, rows):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("a", "x"))
    assert rows(G.dag_violations(nodes(spark, "abcd"), e)) == [
        ("cycle", "b"), ("cycle", "c"), ("cycle", "d"), ("unknown_node", "x")]
    assert rows(G.dag_violations(nodes(spark, "a").limit(0), e.limit(0))) == [("no_nodes", None)]
    assert rows(G.dag_levels(nodes(spark, "a"), edges(spark, ("a", "a")))) == []


def test_compose_errors(spark):
    reg = G.Registry()
    reg.register("n", lambda inputs, args, kwargs, variables: spark.range(int(args[0]) + kwargs.get("plus", 0) + variables.get("more", 0)))
    node = {"id": "1", "type": "n", "data": {"args": " 3 ,", "kwargs": '{"plus": 2}'}}
    assert G.compose([node], [], reg, {"more": 1})["1"].count() == 6
    for bad_nodes, bad_edges in [([], []), ([node], [{"source": "1", "target": "2"}]), ([node], [{"source": "1", "target": "1"}]),
                                 ([{"id": "1", "type": "?"}], [])]:
        with pytest.raises(ValueError):
            G.compose(bad_nodes, bad_edges, reg)


def test_repeated_ids_and_cycles_end(spark, rows):
    """A second row of an id closes a cycle: every walk ends, each node comes once."""
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (2, 3), (4, 3)], "id int, parent_id int")
    assert rows(H.descendants(df, ids_frame(spark, 1))) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3)]
    assert ids(H.reach(df, ids_frame(spark, 2), False)) == [2, 3, 4]
    assert ids(H.reach(df, ids_frame(spark, 4), True)) == [1, 2, 3, 4]
    assert ids(H.tree_paths(df)) == [1, 2, 3, 4]


def test_cascades_stay_in_the_tenant(spark):
    df = spark.createDataFrame([(1, None, "0", 2), (2, 1, "0", 3), (3, 2, "0", 2)], "id int, parent_id int, status string, tenant_id int")
    spec, ctx = TableSpec("t"), Ctx(user_id=1, tenant_id=2)
    off = {r.id: r.status for r in H.cascade_disable(df, ids_frame(spark, 1), spec=spec, ctx=ctx).collect()}
    assert off == {1: "1", 2: "0", 3: "1"}
    assert ids(H.cascade_delete(df, ids_frame(spark, 1), spec=spec, ctx=ctx)) == [2]


def test_partitions_grow_with_the_edges(spark, rows, monkeypatch):
    """However well the names are packed; results stay."""
    monkeypatch.setattr(G, "ARCS_PER_TASK", 50)
    e = spark.range(1_000).selectExpr("'n' || id div 10 AS source", "'m' || id AS target").coalesce(1)
    known = e.selectExpr("target AS id").union(e.select("source"))
    nodes_, arcs, parts = G._graph(known, e, "id", "source", "target")
    assert parts == 21
    for frame in (nodes_, arcs):
        sizes = frame.groupBy(F.spark_partition_id()).count().agg(F.count("*"), F.max("count")).first()
        assert sizes[0] > 15 and sizes[1] < 200
    levels = G.dag_levels(known, e)
    assert sorted(tuple(r) for r in levels.groupBy("level").count().collect()) == [(0, 100), (1, 1_000)]
    assert rows(G.dag_violations(known, e)) == []
