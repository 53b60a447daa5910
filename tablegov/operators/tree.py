"""Hierarchies given as ``(id, parent_id)`` rows, normally one row per id.

Closures advance one level per round: a join of the frontier with the edges,
cut by a checkpoint, stopped when nothing new appears.  A cycle ends a walk
instead of looping: with one row per id a walk down can only come back through
its own root, and upwards the short path so far is kept and tested; where an id
repeats, a walk down leaves out what its root has met before.  Where only the
nodes are wanted, not the pairs, ``reach`` walks sets: a node is in one frontier
only, however many starts lead to it.  Children may pile up under one parent;
Spark splits that side of the join (adaptive skew handling) or broadcasts the
frontier when its measured size allows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegov.operators.mutate import writable
from tablegov.session import cut, held, sized
from tablegov.spec import DISABLED, ENABLED, Ctx, TableSpec


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _links(nodes: DataFrame, id: str, parent: str) -> DataFrame:
    return nodes.select(F.col(id).alias("child"), F.col(parent).alias("above")).filter("above is not null")


def _start(roots: DataFrame) -> DataFrame:
    col = F.col(roots.columns[0])
    return roots.select(col.alias("root_id"), col.alias("id")).distinct().withColumn("depth", F.lit(0))


def descendants(nodes: DataFrame, roots: DataFrame, id="id", parent="parent_id",
                max_depth: int | None = None) -> DataFrame:
    """Each root with everything below it: ``(root_id, id, depth)``.  ``roots``
    is a one-column frame."""
    with held(_links(nodes, id, parent)) as links:
        repeated = not links.groupBy("child").count().filter("count > 1").isEmpty()
        level = cut(_start(roots))
        levels, rows = [level], level.count()
        while max_depth is None or len(levels) <= max_depth:
            front = sized(level, rows)
            below = front.join(links, F.col("id") == F.col("above")).filter("child <> root_id").select(
                "root_id", F.col("child").alias("id"), (F.col("depth") + 1).alias("depth"))
            if repeated:
                below = below.distinct().join(_union(levels).select("root_id", "id"), ["root_id", "id"], "left_anti")
            level = cut(below)
            rows = level.count()
            if not rows:
                break
            levels.append(level)
    return _union(levels)


def reach(nodes: DataFrame, starts: DataFrame, up: bool, id="id", parent="parent_id") -> DataFrame:
    """The nodes among ``starts`` and all above (or below) them: ``id``, each once."""
    known = nodes.select(F.col(id).alias("id"), F.col(parent).alias("above")).filter("id is not null")
    with held(known) as rows:
        first = starts.select(F.col(starts.columns[0]).alias("id")).distinct()
        level = cut(first.join(rows.select("id").distinct(), "id", "left_semi") if up else first)
        levels, n = [level], level.count()
        while n:
            front = sized(level, n)
            if up:
                step = rows.join(front, "id", "left_semi").select(F.col("above").alias("id")).distinct().join(
                    rows.select("id"), "id", "left_semi")
            else:
                step = rows.join(front.withColumnRenamed("id", "above"), "above", "left_semi").select("id").distinct()
            level = cut(step.join(_union(levels), "id", "left_anti"))
            n = level.count()
            if n:
                levels.append(level)
    return _union(levels)


def ancestors(nodes: DataFrame, starts: DataFrame, id="id", parent="parent_id",
              max_depth: int | None = None) -> DataFrame:
    """Each start node with everything above it.  Parent ids that are not
    nodes themselves are left out."""
    known = nodes.select(F.col(id).alias("id"), F.col(parent).alias("above"))
    with held(known) as rows:
        level = cut(_start(starts).join(rows, "id").withColumn("path", F.array("id")))
        levels, n = [level], level.count()
        while max_depth is None or len(levels) <= max_depth:
            step = level.filter(~F.array_contains("path", F.col("above"))).select(
                "root_id", F.col("above").alias("id"), (F.col("depth") + 1).alias("depth"), "path")
            level = cut(sized(step, n).join(rows, "id").withColumn("path", F.concat("path", F.array("id"))))
            n = level.count()
            if not n:
                break
            levels.append(level)
    return _union(levels).select("root_id", "id", "depth")


def self_references(nodes: DataFrame, id="id", parent="parent_id") -> DataFrame:
    """Rows whose parent is the row itself: an error in the upward walk."""
    return nodes.filter(F.col(id) == F.col(parent))


def tree_paths(nodes: DataFrame, id="id", parent="parent_id", orphans: str = "promote") -> DataFrame:
    """``(id, parent_id, root_id, level, path, is_leaf)``.  Of a repeated id the
    row with the smallest parent counts, a null parent last.  A node is a root when
    its parent is null; a node whose parent is missing becomes a root too
    (``promote``) or is left out with its subtree (``drop``)."""
    if orphans not in ("promote", "drop"):
        raise ValueError("orphans is 'promote' or 'drop'")
    rows = nodes.select(F.col(id).alias("id"), F.col(parent).alias("parent_id")).groupBy("id").agg(
        F.min("parent_id").alias("parent_id"))
    tops = rows.filter(F.col("parent_id").isNull())
    if orphans == "promote":
        known = rows.select(F.col("id").alias("parent_id"))
        tops = tops.unionByName(
            rows.filter(F.col("parent_id").isNotNull()).join(known, "parent_id", "left_anti").select("id", "parent_id"))
    return _paths_from(rows, tops)


def _paths_from(rows: DataFrame, tops: DataFrame) -> DataFrame:
    below = rows.select("id", "parent_id").filter("parent_id is not null")
    with held(below) as links:
        level = cut(tops.select("id", "parent_id", F.col("id").alias("root_id"), F.lit(0).alias("level"),
                                F.array("id").alias("path")))
        levels, n = [level], level.count()
        while True:
            above = level.select(F.col("id").alias("parent_id"), "root_id", "level", "path")
            level = cut(links.join(sized(above, n), "parent_id").select(
                "id", "parent_id", "root_id", (F.col("level") + 1).alias("level"),
                F.concat("path", F.array("id")).alias("path")))
            n = level.count()
            if not n:
                break
            levels.append(level)
    parents = rows.select(F.col("parent_id").alias("id")).filter("id is not null").distinct()
    return (
        _union(levels).join(parents.withColumn("_inner", F.lit(True)), "id", "left")
        .withColumn("is_leaf", F.col("_inner").isNull())
        .select("id", "parent_id", "root_id", "level", "path", "is_leaf")
    )


def unreachable(nodes: DataFrame, paths: DataFrame, id="id") -> DataFrame:
    """Nodes no root leads to: members of a cycle and what hangs below one."""
    return nodes.join(paths.select(F.col("id").alias(id)), id, "left_anti")


def tree_options(paths: DataFrame, nodes: DataFrame, id="id", name="name", status="status") -> DataFrame:
    """Value, label and disabled flag of every tree node, with its path."""
    facts = nodes.select(F.col(id).alias("id"), F.col(name).alias("label"),
                         (F.lower(F.col(status).cast("string")) == "false").alias("disabled"))
    return paths.join(facts, "id").select(
        F.col("id").alias("value"), "label",
        F.coalesce("disabled", F.lit(False)).alias("disabled"), "parent_id", "level", "path")


# --- cascades -----------------------------------------------------------------

def _set_where(df: DataFrame, ids: DataFrame, id: str, column: str, value, own: Column) -> DataFrame:
    hit = ids.select(F.col("id").alias(id)).distinct().withColumn("_hit", F.lit(True))
    marked = df.join(hit, id, "left")
    return marked.withColumn(column, F.when(F.col("_hit") & own, F.lit(value)).otherwise(F.col(column))).select(*df.columns)


def _own(spec: TableSpec | None, ctx: Ctx | None) -> Column:
    """Rows of the caller's tenant; all where no caller is given."""
    return F.coalesce(writable(spec, ctx), F.lit(False)) if spec and ctx else F.lit(True)


def cascade_enable(df: DataFrame, ids: DataFrame, id="id", parent="parent_id", status="status",
                   spec: TableSpec | None = None, ctx: Ctx | None = None) -> DataFrame:
    """Enabling a node enables everything above it, within the caller's tenant."""
    return _set_where(df, reach(df, ids, True, id, parent), id, status, ENABLED, _own(spec, ctx))


def cascade_disable(df: DataFrame, ids: DataFrame, id="id", parent="parent_id", status="status",
                    spec: TableSpec | None = None, ctx: Ctx | None = None) -> DataFrame:
    """Disabling a node disables everything below it, within the caller's tenant."""
    return _set_where(df, reach(df, ids, False, id, parent), id, status, DISABLED, _own(spec, ctx))


def cascade_delete(df: DataFrame, ids: DataFrame, id="id", parent="parent_id",
                   spec: TableSpec | None = None, ctx: Ctx | None = None) -> DataFrame:
    """A node goes with everything below it, within the caller's tenant."""
    gone = reach(df, ids, False, id, parent).select(F.col("id").alias(id)).withColumn("_gone", F.lit(True))
    marked = df.join(gone, id, "left")
    return marked.filter(F.col("_gone").isNull() | ~_own(spec, ctx)).select(*df.columns)


# --- selections ---------------------------------------------------------------

def expand_with_ancestors(df: DataFrame, ids: DataFrame, id="id", parent="parent_id") -> DataFrame:
    return reach(df, ids, True, id, parent)


def linked_violations(df: DataFrame, chosen: DataFrame, id="id", parent="parent_id") -> DataFrame:
    """Edges with exactly one chosen end: a chosen parent misses a child, or a
    chosen child misses its parent."""
    picked = chosen.select(F.col(chosen.columns[0]).alias("_pick")).distinct()
    known = df.select(F.col(id).alias("_known")).distinct()
    edges = df.select(F.col(id).alias("child_id"), F.col(parent).alias("parent_id")).join(
        known, F.col("parent_id") == F.col("_known"), "left_semi")
    edges = edges.join(picked.select(F.col("_pick").alias("child_id"), F.lit(True).alias("_c")), "child_id", "left")
    edges = edges.join(picked.select(F.col("_pick").alias("parent_id"), F.lit(True).alias("_p")), "parent_id", "left")
    reason = F.when(F.col("_p").isNotNull() & F.col("_c").isNull(), "child_not_chosen").when(
        F.col("_c").isNotNull() & F.col("_p").isNull(), "parent_not_chosen")
    return edges.withColumn("reason", reason).filter("reason is not null").select("parent_id", "child_id", "reason")


def linked_check(df: DataFrame, chosen: DataFrame, id="id", parent="parent_id") -> bool:
    """False for an empty selection or tree, or when any edge is cut."""
    if chosen.isEmpty() or df.isEmpty():
        return False
    return linked_violations(df, chosen, id, parent).isEmpty()


def has_selected_descendant(df: DataFrame, selected: DataFrame, id="id", parent="parent_id") -> DataFrame:
    """Nodes that are selected or have a selection somewhere below them."""
    return expand_with_ancestors(df, selected, id, parent)


def filter_tree(df: DataFrame, types: list[int], id="id", parent="parent_id", type="type") -> DataFrame:
    """Nodes of the given types whose whole path up consists of such nodes."""
    rows = df.select(F.col(id).alias("id"), F.col(parent).alias("parent_id"), F.col(type).alias("type"))
    known = rows.select(F.col("id").alias("parent_id"))
    tops = rows.filter("parent_id is null").unionByName(
        rows.filter("parent_id is not null").join(known, "parent_id", "left_anti").select("id", "parent_id", "type"))
    kept = F.col("type").isin(types)
    return _paths_from(rows.filter(kept), tops.filter(kept))


def filter_keep_path(df: DataFrame, label: str, text: str, id="id", parent="parent_id") -> DataFrame:
    """Nodes whose label contains ``text``, together with their ancestors."""
    hits = df.filter(F.contains(F.col(label), F.lit(text))).select(id)
    keep = expand_with_ancestors(df, hits, id, parent)
    return df.join(keep.select(F.col("id").alias(id)), id, "left_semi").select(*df.columns)


# Menu types.
DIRECTORY, MENU, BUTTON, LINK = 1, 2, 3, 4


def tree_audit(df: DataFrame, id="id", parent="parent_id", type="type", client="client") -> DataFrame:
    """Rows that break a parent/child type rule or differ from the parent's
    terminal: ``(id, parent_id, reason)``."""
    terminal = F.coalesce(F.nullif(F.col(client), F.lit("")), F.lit("pc"))
    rows = df.select(F.col(id).alias("id"), F.col(parent).alias("parent_id"),
                     F.col(type).alias("type"), terminal.alias("client"))
    above = df.select(F.col(id).alias("parent_id"), F.col(type).alias("_ptype"), terminal.alias("_pclient"),
                      F.lit(True).alias("_found"))
    joined = rows.join(above, "parent_id", "left")
    containers = [DIRECTORY, MENU, LINK]
    rules = [
        (F.col("parent_id").isNull() & ~F.col("type").isin(containers), "top_level_type"),
        (F.col("parent_id").isNotNull() & F.col("_found").isNull(), "parent_missing"),
        ((F.col("_ptype") == DIRECTORY) & ~F.col("type").isin(containers), "directory_child_type"),
        ((F.col("_ptype") == MENU) & (F.col("type") != BUTTON), "menu_child_type"),
        (F.col("_ptype").isin(BUTTON, LINK), "child_below_leaf"),
        (F.col("_pclient") != F.col("client"), "client_differs"),
    ]
    reasons = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]))
    return joined.withColumn("reason", F.explode(reasons)).select("id", "parent_id", "reason")
