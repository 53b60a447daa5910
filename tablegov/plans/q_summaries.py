"""Summaries written in two parts, read back and merged into weeks, next to the
exact figures of the events: the estimates must lie within the stated errors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegov.functions.text import fmt_ts
from tablegov.operators import summaries as Z
from tablegov.plans.registry import query
from tablegov.session import ensure_checkpoint_dir


def _stored(v, rows: DataFrame, late: str, **what) -> DataFrame:
    """Summaries of ``rows``; one row in ten comes after the others, as a late part."""
    ensure_checkpoint_dir(v.spark)
    path = f"{v.spark.sparkContext.getCheckpointDir()}/summary-{uuid.uuid4().hex}"
    is_late = F.pmod(F.xxhash64(late), F.lit(10)) == 0
    for part in (rows.where(~is_late), rows.where(is_late)):
        Z.summarise(part, **what).write.mode("append").parquet(path)
    return v.spark.read.parquet(path)


def _week(time: str = "slot"):
    return F.date_trunc("week", time)


@query("pv_uv_stored", """SELECT strftime(date_trunc('week', ts), '%Y-%m-%d %H:%M:%S') AS week, count(*) AS pv, count(DISTINCT user_id) AS uv, true AS near
    FROM events GROUP BY 1""")
def _(v):
    exact = v.events.groupBy(_week("ts").alias("span")).agg(F.count_distinct("user_id").alias("exact"))
    weeks = Z.merge(_stored(v, v.events, "event_id", ts="ts", user="user_id"), _week()).join(exact, "span")
    near = F.abs(F.col("uv") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * Z.COUNT_ERROR)
    return weeks.select(fmt_ts(F.col("span")).alias("week"), F.col("n").alias("pv"), F.col("exact").alias("uv"), near.alias("near"))


@query("value_quantiles_stored", """SELECT event_type, strftime(date_trunc('week', ts), '%Y-%m-%d %H:%M:%S') AS week, count(*) AS n, true AS near_p50, true AS near_p99
    FROM events GROUP BY 1, 2""")
def _(v):
    points = {"p50": 0.5, "p99": 0.99}
    weeks = Z.merge(_stored(v, v.events, "event_id", ts="ts", by=["event_type"], value="value"), _week(), ["event_type"], points)
    # The share of values below an estimate, and up to it, are on both sides of its rank.
    rows = v.events.select("event_type", _week("ts").alias("span"), "value").join(weeks, ["event_type", "span"])
    aggs = [F.max("n").alias("n")]
    for name, p in points.items():
        below = F.count_if(F.col("value") < F.col(name)) / F.count("value")
        upto = F.count_if(F.col("value") <= F.col(name)) / F.count("value")
        aggs.append(((below <= p + Z.RANK_ERROR) & (upto >= p - Z.RANK_ERROR)).alias(f"near_{name}"))
    return rows.groupBy("event_type", "span").agg(*aggs).select(
        "event_type", fmt_ts(F.col("span")).alias("week"), "n", "near_p50", "near_p99")
