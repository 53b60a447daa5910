"""Directed graphs: validation, levels, and composing named transforms."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegov.session import cut, held, sized

# Edges to one partition.  Names of nodes shrink so much when they are shuffled that the
# sizes Spark merges partitions by say little about what a task then keeps.
ARCS_PER_TASK = 500_000


def _levels(known: DataFrame, arcs: DataFrame, parts: int) -> DataFrame:
    due = arcs.select(F.col("target").alias("id")).repartition(parts, "id").groupBy("id").agg(
        F.count(F.lit(1)).alias("due"))
    free = cut(known.join(due, "id", "left_anti"))
    rounds, n = [free.withColumn("level", F.lit(0))], free.count()
    # Nodes that have had some of their counts, not all: what a round rewrites follows the frontier.
    touched = None
    with held(due.join(known, "id", "left_semi")) as due:
        while n:
            sent = sized(free, n).join(arcs, F.col("id") == F.col("source")).groupBy(F.col("target").alias("id")).agg(
                F.count(F.lit(1)).alias("got"))
            if touched is not None:
                sent = touched.unionByName(sent).groupBy("id").agg(F.sum("got").alias("got"))
            state = cut(sent.join(due, "id").select("id", "got", (F.col("got") == F.col("due")).alias("full")))
            free = state.filter("full").select("id")
            touched = state.filter("NOT full").select("id", "got")
            n = free.count()
            if n:
                rounds.append(free.withColumn("level", F.lit(len(rounds))))
    return reduce(lambda a, b: a.unionByName(b), rounds)


def _graph(nodes: DataFrame, edges: DataFrame, id: str, source: str, target: str) -> tuple[DataFrame, DataFrame, int]:
    """Distinct nodes by id, edges by source, and the number of partitions that both
    have, which grows with the edges."""
    arcs = edges.select(F.col(source).alias("source"), F.col(target).alias("target"))
    parts = max(arcs.sparkSession.sparkContext.defaultParallelism, arcs.count() // ARCS_PER_TASK + 1)
    return (nodes.select(F.col(id).alias("id")).repartition(parts, "id").distinct(),
            arcs.repartition(parts, "source"), parts)


def dag_levels(nodes: DataFrame, edges: DataFrame, id="id", source="source", target="target") -> DataFrame:
    """``(id, level)`` in topological order.  A round sends one count along the
    edges of the nodes freed last; a node is free once as many counts have
    arrived as edges point to it, repeated edges included.  Nodes on or behind a cycle never are, so the
    loop ends and they get no level."""
    known, arcs, parts = _graph(nodes, edges, id, source, target)
    with held(arcs) as arcs:
        return _levels(known, arcs, parts)


def dag_violations(nodes: DataFrame, edges: DataFrame, id="id", source="source", target="target") -> DataFrame:
    """``(reason, item)``: edges with an unknown end, nodes on or behind a cycle,
    or one row for a graph without nodes."""
    known, arcs, parts = _graph(nodes, edges, id, source, target)
    with held(arcs) as arcs, held(known) as known:
        ends = arcs.select(F.col("source").alias("id")).unionByName(arcs.select(F.col("target").alias("id"))).repartition(
            parts, "id").distinct()
        unknown = ends.join(known, "id", "left_anti").select(
            F.lit("unknown_node").alias("reason"), F.col("id").cast("string").alias("item"))
        cyclic = known.join(_levels(known, arcs, parts).select("id"), "id", "left_anti").select(
            F.lit("cycle").alias("reason"), F.col("id").cast("string").alias("item"))
        empty = known.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(
            F.lit("no_nodes").alias("reason"), F.lit(None).cast("string").alias("item"))
        return cut(unknown.unionByName(cyclic).unionByName(empty))


def upstream(nodes: DataFrame, edges: DataFrame, id="id", source="source", target="target") -> DataFrame:
    """The inputs of each node, one row per edge: ``(id, input)``."""
    known = nodes.select(F.col(id).alias("id"))
    arcs = edges.select(F.col(target).alias("id"), F.col(source).alias("input")).join(known, "id", "left_semi")
    return arcs.join(known.select(F.col("id").alias("input")), "input", "left_semi").select("id", "input").distinct()


class Registry:
    """Named transforms ``fn(inputs, args, kwargs, variables) -> DataFrame``.
    Code is registered as functions; text is never executed."""

    def __init__(self) -> None:
        self._types: dict[str, tuple[Callable[..., DataFrame], str | None, str | None]] = {}

    def register(self, name: str, fn: Callable[..., DataFrame], args: str | None = None,
                 kwargs: str | None = None) -> None:
        self._types[name] = (fn, args, kwargs)

    def get(self, name: str):
        if name not in self._types:
            raise ValueError(f"unknown node type: {name}")
        return self._types[name]


def parse_args(text: str | None) -> list[str]:
    return [part.strip() for part in (text or "").split(",") if part.strip()]


def parse_kwargs(text: str | None) -> dict:
    import json

    try:
        value = json.loads(text) if text else {}
    except ValueError:
        value = {}
    return value if isinstance(value, dict) else {}


def compose(nodes: list[dict], edges: list[dict], registry: Registry, variables: dict | None = None,
            ) -> dict[str, DataFrame]:
    """Chain the transforms of a small hand-drawn definition into lazy frames,
    one per node.  Nothing runs until a caller acts on a result; each sink is
    one Spark plan."""
    if not nodes:
        raise ValueError("a workflow needs at least one node")
    by_id = {n["id"]: n for n in nodes}
    feeds: dict[str, list[str]] = {n: [] for n in by_id}
    for edge in edges:
        if edge.get("source") not in by_id or edge.get("target") not in by_id:
            raise ValueError("an edge names an unknown node")
        feeds[edge["target"]].append(edge["source"])
    try:
        sequence = list(TopologicalSorter(feeds).static_order())
    except CycleError as err:
        raise ValueError("the workflow has a cycle") from err
    results: dict[str, DataFrame] = {}
    for node_id in sequence:
        node = by_id[node_id]
        fn, args, kwargs = registry.get(node.get("type") or "")
        data = node.get("data") or {}
        own_args, own_kwargs = data.get("args"), data.get("kwargs")
        results[node_id] = fn(
            {source: results[source] for source in feeds[node_id]},
            parse_args(args if own_args is None else own_args),
            parse_kwargs(kwargs if own_kwargs is None else own_kwargs),
            dict(variables or {}),
        )
    return results
