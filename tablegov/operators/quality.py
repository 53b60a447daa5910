"""Audits and import reports.

Reports stay row-shaped: a list of all offending row numbers in one cell would
grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegov.operators.ordering import number_rows


def unique_audit(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def null_rows(df: DataFrame, required: list[str], row_no: str = "row_no") -> DataFrame:
    """``(field, row_no)`` for every missing required value."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    return df.select(F.explode(missing).alias("field"), F.col(row_no))


def null_report(df: DataFrame, required: list[str], row_no: str = "row_no") -> DataFrame:
    """Per field: how many rows miss it, the first and the last of them."""
    return null_rows(df, required, row_no).groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), F.min(row_no).alias("first_row"), F.max(row_no).alias("last_row"))


def with_row_no(df: DataFrame, order, name: str = "row_no") -> DataFrame:
    return number_rows(df, order, name)


def import_summary(report: DataFrame) -> DataFrame:
    """Success and error counts of an import report."""
    good = F.col("outcome").isin("created", "updated")
    return report.agg(F.count_if(good).alias("success_count"), F.count_if(~good).alias("error_count"))


def error_lines(report: DataFrame, key: str, row_no: str = "row_no") -> DataFrame:
    """One line per rejected row, in row order when sorted by ``row_no``."""
    return report.filter(~F.col("outcome").isin("created", "updated")).select(
        row_no, F.format_string("row %d: %s %s", F.col(row_no), F.col(key).cast("string"), F.col("outcome")).alias("line"))


def label_codes(df: DataFrame, labels: dict[str, dict], default: str = "未知") -> DataFrame:
    """Codes replaced by labels, per column; unknown codes get ``default``."""
    out = df
    for column, mapping in labels.items():
        table = F.create_map(*[F.lit(x) for code, label in mapping.items() for x in (str(code), label)])
        out = out.withColumn(column, F.coalesce(
            F.try_element_at(table, F.col(column).cast("string")), F.lit(default)))
    return out


# Labels of the common codes.
LABELS = {
    "status": {"0": "启用", "1": "停用"},
    "notice_type": {"1": "通知", "2": "公告"},
    "gender": {"0": "男", "1": "女", "2": "未知"},
    "data_scope": {1: "仅本人数据权限", 2: "本部门数据权限", 3: "本部门及以下数据权限", 4: "全部数据权限", 5: "自定义数据权限"},
    "log_type": {1: "登录日志", 2: "操作日志"},
}


def response_label(code: Column) -> Column:
    return F.when(code == 200, "成功").otherwise("失败")


def project_out(df: DataFrame, schema, defaults: dict | None = None) -> DataFrame:
    """The declared fields only, cast to their types; missing ones take their
    default or null."""
    cols = []
    for f in schema.fields:
        given = F.col(f.name) if f.name in df.columns else F.lit((defaults or {}).get(f.name))
        cols.append(given.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def options(df: DataFrame, fields: dict[str, Column], status: str = "status", sort: str = "sort",
            key: str = "id") -> DataFrame:
    """Enabled rows as options, in sort order then key."""
    return df.filter(F.col(status) == "0").orderBy(sort, key).select(
        *[expr.alias(name) for name, expr in fields.items()])
