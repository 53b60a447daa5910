"""Dashboard and log aggregates.

Every aggregate combines on the map side.  Windows run only over frames that an
aggregation has already reduced to slots, categories or a top-n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegov.functions.files import ancestors_of, path_parent
from tablegov.functions.text import handler_label
from tablegov.operators.ordering import first_of_key, number_rows

# Handlers left out of request metrics, latency bucket bounds (s).
EXCLUDED_HANDLERS = ["/metrics", "/health", "/health/live", "/health/ready", "/docs", "/redoc", "/ljdoc",
                     "/openapi.json", "/static/.*", "/favicon.ico"]
LATENCY_BUCKETS = [0.1, 0.5, 1.0]


def money_sum(col: Column | str) -> Column:
    """Sum of amounts with two decimals, added up as whole cents: the result
    does not depend on the row order, and cents avoid the slow cast of a double
    to a decimal."""
    amount = F.col(col) if isinstance(col, str) else col
    cents = F.floor(amount * 100 + 0.5).cast("decimal(18,0)")
    return F.sum(cents).cast("double") / 100


def exact_sum(col: Column | str) -> Column:
    """Sum to six decimals, added up as whole millionths: independent of the row
    order and fine enough for seconds."""
    value = F.col(col) if isinstance(col, str) else col
    return F.sum(F.floor(value * 1_000_000 + 0.5).cast("decimal(18,0)")).cast("double") / 1_000_000


def _slot_window() -> Window:
    """For frames of one row per time slot: their number is bounded by the
    calendar, not by the data."""
    return Window.partitionBy(F.lit(0))


# --- requests -----------------------------------------------------------------

def request_metrics(log: DataFrame, buckets=LATENCY_BUCKETS, method="method", handler="path", code="code",
                    latency="latency", request_size=None, response_size=None,
                    excluded=EXCLUDED_HANDLERS) -> DataFrame:
    """Per method, handler and status class: requests, latency sum, a
    cumulative histogram (``le_<bound>``), and sizes where given."""
    kept = log.filter(~F.col(handler).rlike("^(?:" + "|".join(excluded) + ")$"))
    aggs = [F.count(F.lit(1)).alias("requests"), exact_sum(latency).alias("latency_sum")]
    aggs += [F.count_if(F.col(latency) <= b).alias(f"le_{str(b).replace('.', '_')}") for b in buckets]
    for size in (request_size, response_size):
        if size:
            aggs.append(F.sum(size).alias(f"{size}_sum"))
    return kept.groupBy(
        F.col(method).alias("method"), F.col(handler).alias("handler"), handler_label(F.col(code)).alias("status"),
    ).agg(*aggs)


def service_level(log: DataFrame, seconds: Column | float, latency="latency", code="code",
                  by: list[str] | None = None, exact: bool = False) -> DataFrame:
    """QPS, P99, error rate and availability.  The default percentile is a
    mergeable sketch of bounded size; ``exact`` takes it from row positions."""
    by = by or []
    failed = F.avg((F.col(code) >= 500).cast("int"))
    rates = [(F.count(F.lit(1)) / seconds).alias("qps"), failed.alias("error_rate"), (1 - failed).alias("availability")]
    if not exact:
        return log.groupBy(*by).agg(*rates, F.percentile_approx(latency, 0.99, 10_000).alias("p99"))
    basic, top = log.groupBy(*by).agg(*rates), exact_percentile(log, latency, 0.99, by, "p99")
    return basic.join(top, by, "left") if by else basic.withColumn("p99", top.select("p99").scalar())


def exact_percentile(df: DataFrame, value: str, p: float, by: list[str], name: str, **ranges) -> DataFrame:
    """Interpolated percentile per group.  Rows are counted per distinct value
    first, so a frequent value is one row; the running counts are taken in
    ranges, and no task holds a whole group.  The group columns must not be
    null."""
    values = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_many"))
    placed = number_rows(values, [value], "_pos", keys=by, weight="_many", **ranges)
    sizes = values.groupBy(*by).agg((F.lit(p) * (F.sum("_many") - 1) + 1).alias("_at"))
    marked = placed.join(sizes, by) if by else placed.withColumn("_at", sizes.select("_at").scalar())
    low = F.min(F.when(F.col("_pos") >= F.floor("_at"), F.col(value)))
    high = F.min(F.when(F.col("_pos") >= F.ceil("_at"), F.col(value)))
    at = F.max("_at")
    return marked.groupBy(*by).agg((low + (high - low) * (at - F.floor(at))).alias(name))


# --- sessions, messages, jobs -------------------------------------------------

def session_buckets(df: DataFrame, ts: str, now: str) -> DataFrame:
    """Rows marked today / yesterday / week / earlier by day bounds before
    ``now``; rows without a time are left out."""
    day = F.date_trunc("day", F.lit(now).cast(df.schema[ts].dataType))
    at = F.col(ts)
    bucket = (F.when(at >= day, "today").when(at >= day - F.expr("interval 1 day"), "yesterday")
              .when(at >= day - F.expr("interval 7 days"), "week").otherwise("earlier"))
    return df.filter(at.isNotNull()).withColumn("bucket", bucket)


def message_stats(messages: DataFrame, session="session_id", role="role", content: str | None = None) -> DataFrame:
    """Messages per session; rows without a role do not count."""
    spoken = F.coalesce(F.col(role), F.lit("")) != ""
    aggs = [F.count_if(spoken).alias("message_count"), F.count_if(F.col(role) == "user").alias("user_messages")]
    if content:
        aggs.append(F.sum(F.when(spoken, F.length(content))).alias("characters"))
    return messages.groupBy(session).agg(*aggs)


def job_status_summary(jobs: DataFrame, job="job_id", status="status") -> DataFrame:
    return jobs.groupBy(status).agg(F.count(F.lit(1)).alias("runs"), F.count_distinct(job).alias("jobs"))


# --- files --------------------------------------------------------------------

def dir_totals(files: DataFrame, path="path", size="size") -> DataFrame:
    """Per directory: direct files, direct sub-directories, size of the files."""
    direct = files.groupBy(path_parent(F.col(path)).alias("dir")).agg(
        F.count(F.lit(1)).alias("files"), F.sum(size).alias("size"))
    known = _directories(files, path)
    subs = known.filter("dir <> ''").groupBy(path_parent(F.col("dir")).alias("dir")).agg(
        F.count(F.lit(1)).alias("dirs"))
    return known.join(direct, "dir", "left").join(subs, "dir", "left").select(
        "dir", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("dirs", F.lit(0)).alias("dirs"),
        F.coalesce("size", F.lit(0)).alias("size"))


def _directories(files: DataFrame, path: str) -> DataFrame:
    """All directories that hold something; parents are made distinct first."""
    parents = files.select(path_parent(F.col(path)).alias("p")).distinct()
    above = F.when(F.col("p") == "", F.array(F.lit(""))).otherwise(
        F.concat(ancestors_of(F.col("p")), F.array("p")))
    return parents.select(F.explode(above).alias("dir")).distinct()


def tree_totals(files: DataFrame, path="path", size="size") -> DataFrame:
    """Per directory: files, directories and size anywhere below it.  Files are
    summed per directory before they are spread over their ancestors."""
    direct = files.groupBy(path_parent(F.col(path)).alias("p")).agg(
        F.count(F.lit(1)).alias("files"), F.sum(size).alias("size"))
    above = F.when(F.col("p") == "", F.array(F.lit(""))).otherwise(F.concat(ancestors_of(F.col("p")), F.array("p")))
    spread = direct.select(F.explode(above).alias("dir"), "files", "size").groupBy("dir").agg(
        F.sum("files").alias("files"), F.sum("size").alias("size"))
    below = _directories(files, path).filter("dir <> ''").select(
        F.explode(ancestors_of(F.col("dir"))).alias("dir")).groupBy("dir").agg(F.count(F.lit(1)).alias("dirs"))
    return spread.join(below, "dir", "left").select(
        "dir", "files", F.coalesce("dirs", F.lit(0)).alias("dirs"), "size")


# --- tenants ------------------------------------------------------------------

def quota_usage(tenants: DataFrame, quotas: DataFrame, used: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """``used`` maps a resource to a frame with ``tenant_id`` and the aggregate
    that measures it; ``quotas(tenant_id, resource, max_value)``."""
    out = None
    for resource, (df, measure) in used.items():
        part = df.groupBy("tenant_id").agg(measure.cast("double").alias("used")).withColumn(
            "resource", F.lit(resource))
        out = part if out is None else out.unionByName(part)
    wanted = quotas.join(tenants.select(F.col("id").alias("tenant_id")), "tenant_id", "left_semi")
    return wanted.join(out, ["tenant_id", "resource"], "left").select(
        "tenant_id", "resource", "max_value", F.coalesce("used", F.lit(0.0)).alias("used")).withColumn(
        "over_quota", F.col("used") > F.col("max_value"))


# --- dashboards ---------------------------------------------------------------

def funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """``(step_no, step, n, rate)`` with the rate against the first step in
    whole percent.  One pass counts every step."""
    counted = df.agg(*[F.count_if(cond).alias(f"s{i}") for i, (_, cond) in enumerate(steps)])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("step_no"), F.lit(name).alias("step"), F.col(f"s{i}").alias("n"),
                              F.col("s0").alias("first")) for i, (name, _) in enumerate(steps)])
    return counted.select(F.inline(rows)).select(
        "step_no", "step", "n", F.round(F.lit(100) * F.col("n") / F.nullif(F.col("first"), F.lit(0))).alias("rate"))


def pv_uv(df: DataFrame, ts: str, user: str, width: str = "2 hours", approx: bool = False) -> DataFrame:
    """Views and unique visitors per slot."""
    unique = F.approx_count_distinct(user) if approx else F.count_distinct(user)
    return df.groupBy(F.window(ts, width).alias("w")).agg(
        F.count(F.lit(1)).alias("pv"), unique.alias("uv")).select(F.col("w.start").alias("slot"), "pv", "uv")


def share(df: DataFrame, dim: str, measure: Column) -> DataFrame:
    """Value and percent of the total per category; the total is a scalar
    subquery over the grouped frame."""
    grouped = df.groupBy(dim).agg(measure.alias("value"))
    total = grouped.agg(F.sum("value")).scalar()
    return grouped.withColumn("percent", F.round(F.lit(100) * F.col("value") / total, 2))


def counts_by(df: DataFrame, dim: str | list[str]) -> DataFrame:
    return df.groupBy(*([dim] if isinstance(dim, str) else dim)).agg(F.count(F.lit(1)).alias("n"))


def net_sales(df: DataFrame, slot: Column, amount: Column, refunded: Column) -> DataFrame:
    """Amount, refund and what is left per slot."""
    return df.groupBy(slot.alias("slot")).agg(
        money_sum(amount).alias("amount"), money_sum(F.when(refunded, amount).otherwise(0)).alias("refund"),
        money_sum(F.when(refunded, 0).otherwise(amount)).alias("actual"))


def rating_mean(df: DataFrame, score: Column, by: list[str], digits: int = 1) -> DataFrame:
    return df.groupBy(*by).agg(F.round(F.avg(score), digits).alias("rating"))


def kpi(orders: DataFrame, events: DataFrame, amount="amount", user="user_id", bought: Column | None = None) -> DataFrame:
    """Sales, orders, active users and conversion as one row.  Each table is
    read once; the figures meet as scalar subqueries."""
    visits = events.agg(
        F.count_distinct(user).alias("active"), F.count_distinct(F.when(bought, F.col(user))).alias("buyers"))
    active, buyers = visits.select("active").scalar(), visits.select("buyers").scalar()
    sales = orders.agg(money_sum(amount).alias("total_sales"), F.count(F.lit(1)).alias("orders"))
    return sales.withColumn("active_users", active).withColumn(
        "conversion", F.round(F.lit(100) * buyers / F.nullif(active, F.lit(0)), 2))


def new_vs_returning(df: DataFrame, user: str, ts: str, slot: str) -> DataFrame:
    """Unique visitors per calendar slot, split by whether it is their first."""
    seen = df.select(user, F.date_trunc(slot, F.col(ts)).alias("slot")).distinct()
    first = seen.groupBy(user).agg(F.min("slot").alias("_first"))
    return seen.join(first, user).groupBy("slot").agg(
        F.count_if(F.col("slot") == F.col("_first")).alias("new_users"),
        F.count_if(F.col("slot") > F.col("_first")).alias("returning_users"))


def compare_periods(df: DataFrame, slot: Column, period: Column, value: Column, periods: list) -> DataFrame:
    """Average per slot, one column per period."""
    return df.select(slot.alias("slot"), period.alias("_p"), value.alias("_v")).groupBy("slot").pivot(
        "_p", periods).agg(F.round(F.avg("_v"), 4))


# --- windows ------------------------------------------------------------------

def latest_per_key(df: DataFrame, key: list[str], ts: str, tiebreak: str, cond: Column | None = None) -> DataFrame:
    """Newest row per key; of equal times the largest ``tiebreak``."""
    return first_of_key(df if cond is None else df.filter(cond), key, [(ts, "desc"), (tiebreak, "desc")])


def row_index(df: DataFrame, order, name: str = "row_no") -> DataFrame:
    return number_rows(df, order, name)


def rank_ratio(df: DataFrame, dim: str, value: Column, n: int) -> DataFrame:
    """The ``n`` best categories with rank and whole-percent ratio to the best.
    Only the ``n`` rows reach the window."""
    best = df.groupBy(dim).agg(value.alias("value")).orderBy(F.col("value").desc(), F.col(dim)).limit(n)
    over = _slot_window()
    return best.select(
        dim, "value", F.rank().over(over.orderBy(F.col("value").desc())).alias("rank"),
        F.round(F.lit(100) * F.col("value") / F.nullif(F.max("value").over(over), F.lit(0))).alias("ratio"))


def growth(slots: DataFrame, slot: str, value: str) -> DataFrame:
    """Against the previous slot in percent, and the running total."""
    over = _slot_window().orderBy(slot)
    before = F.lag(value).over(over)
    running = F.sum(F.col(value).cast("decimal(28,6)")).over(over.rowsBetween(Window.unboundedPreceding, 0))
    return slots.select(
        slot, value, F.round(F.lit(100) * (F.col(value) - before) / F.nullif(before, F.lit(0)), 2).alias("growth"),
        running.cast("double").alias("running_total"))


def target_vs_actual(slots: DataFrame, slot: str, value: str, k: int = 3) -> DataFrame:
    """Target is the mean of the ``k`` slots before."""
    over = _slot_window().orderBy(slot).rowsBetween(-k, -1)
    target = (F.sum(F.col(value).cast("decimal(28,6)")).over(over).cast("double") / F.count(value).over(over))
    return slots.select(slot, value, F.round(target, 2).alias("target"),
                        F.round(F.lit(100) * F.col(value) / F.nullif(target, F.lit(0)), 2).alias("percent"))
