"""Differences between two versions of a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The column facts a schema comparison looks at.
COLUMN_FIELDS = ["column_type", "column_comment", "column_default", "column_length",
                 "is_pk", "is_increment", "is_nullable", "is_unique"]


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str] | None = None,
                  keep_unchanged: bool = False) -> DataFrame:
    """``(keys, change, change_fields)`` with change in added, removed, changed
    (and unchanged on request).  One full outer join, null-safe compare."""
    fields = [c for c in old.columns if c not in keys] if fields is None else fields
    left = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in fields], F.lit(True).alias("_old"))
    right = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in fields], F.lit(True).alias("_new"))
    joined = left.join(right, keys, "full")
    differing = F.array_compact(F.array(*[
        F.when(~F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}")), F.lit(c)) for c in fields])) if fields else F.array()
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(
        F.size("_differing") > 0, "changed").otherwise("unchanged")
    out = joined.withColumn("_differing", differing.cast("array<string>")).withColumn("change", change)
    out = out.withColumn("change_fields", F.when(F.col("change") == "changed", F.col("_differing")).otherwise(
        F.array().cast("array<string>")))
    if not keep_unchanged:
        out = out.filter("change <> 'unchanged'")
    return out.select(*keys, "change", "change_fields")


def row_diff(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole rows that came and went, duplicates counted."""
    return new.exceptAll(old), old.exceptAll(new)


def schema_diff(current: DataFrame, incoming: DataFrame, name: str = "column_name") -> DataFrame:
    """Column lists compared on the fixed facts; rows without a name are ignored."""
    named = F.coalesce(F.col(name), F.lit("")) != ""
    return snapshot_diff(current.filter(named), incoming.filter(named), [name], COLUMN_FIELDS, keep_unchanged=True)


def diff_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


# What a user may have chosen for a column, what a key column forces.
PRESERVED = ["dict_type", "query_type", "python_field", "python_type", "is_insert", "is_edit", "is_list",
             "is_query", "sort"]
KEY_FORCED_OFF = ["is_insert", "is_edit", "is_list", "is_query"]
DEFAULT_WIDGET = "input"


def sync_columns(current: DataFrame, incoming: DataFrame, keys: list[str], preserved: list[str] | None = None) -> DataFrame:
    """Incoming column list with the user's earlier choices put back.  Removed
    columns disappear; key columns are kept out of forms, lists and queries."""
    kept = [c for c in (PRESERVED if preserved is None else preserved) if c in incoming.columns and c in current.columns]
    extra = [c for c in ("html_type", "is_nullable") if c in incoming.columns and c in current.columns]
    side = current.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in kept + extra], F.lit(True).alias("_had"))
    out = incoming.join(side, keys, "left")
    is_key = F.coalesce(F.col("is_pk"), F.lit(False))
    for c in kept:
        given = F.col(f"_p_{c}")
        if incoming.schema[c].dataType.typeName() == "string":
            given = F.nullif(given, F.lit(""))
        out = out.withColumn(c, F.coalesce(given, F.col(c)))
    if "html_type" in extra:
        chosen = F.nullif(F.nullif(F.col("_p_html_type"), F.lit("")), F.lit(DEFAULT_WIDGET))
        out = out.withColumn("html_type", F.coalesce(chosen, F.col("html_type")))
    if "is_nullable" in extra:
        out = out.withColumn("is_nullable", F.when(~is_key & F.col("_had"), F.col("_p_is_nullable")).otherwise(
            F.col("is_nullable")))
    for c in [c for c in KEY_FORCED_OFF if c in incoming.columns]:
        out = out.withColumn(c, F.when(is_key, F.lit(False)).otherwise(F.col(c)))
    if "query_type" in incoming.columns:
        out = out.withColumn("query_type", F.when(~is_key, F.col("query_type")))
    return out.select(*incoming.columns)
