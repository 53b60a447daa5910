"""Sorting, paging, top-k and set operations."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegov.operators.conditions import where
from tablegov.operators.ordering import first_of_key, normalise, number_rows, sort_columns

# Page size bounds, default page order, cap of a file listing.
MAX_PAGE_SIZE = 100
DEFAULT_PAGE_SIZE = 10
DEFAULT_ORDER = [("updated_time", "desc")]

# Up to this offset a page is a top-n: every task keeps its best rows and they
# meet in one place.  Beyond it rows are found by position instead.
DEEP_OFFSET = 10_000


def ordering(df: DataFrame, order, key: str | None = None) -> list[tuple[str, str]]:
    """Checked sort list with the key appended, so that pages never overlap."""
    out = normalise(order)
    unknown = [c for c, _ in out if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown sort column: {unknown}")
    if key and key not in [c for c, _ in out]:
        out.append((key, "asc"))
    return out


def parse_order(text: str | None) -> list[tuple[str, str]]:
    """Sort list from its JSON text; unusable text means the default order."""
    import json

    try:
        items = json.loads(text) if text else None
    except ValueError:
        items = None
    ok = isinstance(items, list) and items and all(isinstance(i, dict) for i in items)
    return normalise(items) if ok else list(DEFAULT_ORDER)


def order(df: DataFrame, by, key: str | None = None) -> DataFrame:
    return df.orderBy(*sort_columns(ordering(df, by, key)))


def count_rows(df: DataFrame, key: str | None = None, name: str = "total") -> DataFrame:
    return df.agg(F.count(key if key else F.lit(1)).alias(name))


def count_where(df: DataFrame, search: dict, by: list[str] | None = None, name: str = "n") -> DataFrame:
    hits = where(df, search)
    return hits.groupBy(*by).agg(F.count(F.lit(1)).alias(name)) if by else count_rows(hits, name=name)


@dataclass
class Page:
    """``items`` stays lazy; ``total`` is one pruned count, run when first asked for."""

    items: DataFrame
    counted: DataFrame
    page_no: int
    page_size: int

    @cached_property
    def total(self) -> int:
        return self.counted.first()[0]

    @property
    def has_next(self) -> bool:
        return self.page_no * self.page_size < self.total


def _window(page_no: int, page_size: int) -> int:
    if page_no < 1:
        raise ValueError("page_no starts at 1")
    if not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page_size must be 1..{MAX_PAGE_SIZE}")
    return (page_no - 1) * page_size


def rows_at(df: DataFrame, offset: int, size: int, by, key: str = "id") -> DataFrame:
    """``size`` rows from ``offset`` on, in the given order."""
    if offset <= DEEP_OFFSET:
        return order(df, by, key).offset(offset).limit(size)
    spec = ordering(df, by, key)
    numbered = number_rows(df, spec, "_row_no")
    part = numbered.filter(F.col("_row_no").between(offset + 1, offset + size)).drop("_row_no")
    return part.orderBy(*sort_columns(spec))


def page(df: DataFrame, page_no: int = 1, page_size: int = DEFAULT_PAGE_SIZE, by=None,
         search: dict | None = None, key: str = "id") -> Page:
    offset = _window(page_no, page_size)
    rows = where(df, search)
    items = rows_at(rows, offset, page_size, by or [(key, "asc")], key)
    return Page(items, count_rows(rows, key), page_no, page_size)


def page_frame(df: DataFrame, page_no: int = 1, page_size: int = DEFAULT_PAGE_SIZE, by=None,
               search: dict | None = None, key: str = "id") -> DataFrame:
    """The page as one frame with ``total``, ``page_no``, ``page_size`` and
    ``has_next`` columns.  The total is a scalar subquery, not a window: a
    window over everything would pull the table into one task."""
    offset = _window(page_no, page_size)
    rows = where(df, search)
    items = rows_at(rows, offset, page_size, by or [(key, "asc")], key)
    total = count_rows(rows, key).scalar()
    return (
        items.withColumn("total", total)
        .withColumn("page_no", F.lit(page_no))
        .withColumn("page_size", F.lit(page_size))
        .withColumn("has_next", F.lit(offset + page_size) < F.col("total"))
    )


def keyset_page(df: DataFrame, by, after: dict | None, page_size: int, key: str = "id") -> DataFrame:
    """The page that follows the row ``after``.  Rows before it are cut by a
    filter on the leading sort column, so depth costs nothing; the sort
    columns must not be null."""
    spec = ordering(df, by, key)
    out = df
    if after is not None:
        steps = []
        for i, (name, direction) in enumerate(spec):
            here = F.lit(str(after[name])).cast(df.schema[name].dataType)
            same = [F.col(n) == F.lit(str(after[n])).cast(df.schema[n].dataType) for n, _ in spec[:i]]
            step = F.col(name) < here if direction == "desc" else F.col(name) > here
            steps.append(reduce(lambda a, b: a & b, [*same, step]))
        name, direction = spec[0]
        first = F.lit(str(after[name])).cast(df.schema[name].dataType)
        # The range on the leading column is what the file scan can use.
        out = out.filter(F.col(name) <= first if direction == "desc" else F.col(name) >= first)
        out = out.filter(reduce(lambda a, b: a | b, steps))
    return out.orderBy(*sort_columns(spec)).limit(page_size)


def latest(df: DataFrame, n: int, ts: str = "created_time", key: str = "id") -> DataFrame:
    return df.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(n)


def get_one(df: DataFrame, search: dict, key: str = "id") -> DataFrame:
    """First match by key, or an empty frame."""
    return where(df, search).orderBy(key).limit(1)


def sort_items(df: DataFrame, conds: list[dict] | None, name: str = "name",
               first_direction_for_all: bool = False) -> DataFrame:
    """File listing order: name ascending by default; all items, in order.
    ``first_direction_for_all`` reproduces the old rule that the first
    direction governs every key."""
    spec = [(c.get("field", name), c.get("direction", "asc")) for c in conds or []] or [(name, "asc")]
    if first_direction_for_all:
        spec = [(c, spec[0][1]) for c, _ in spec]
    return df.orderBy(*sort_columns(spec))


def sort_desc_by_login(df: DataFrame, column: str = "login_time") -> DataFrame:
    return df.orderBy(F.coalesce(F.col(column), F.lit("")).desc())


# --- set operations -----------------------------------------------------------

def feed(parts: Iterable[tuple[DataFrame, dict]]) -> DataFrame:
    """Differently shaped frames merged into one feed; each part gives the
    expression of every feed column."""
    shaped = [df.select(*[expr.alias(name) for name, expr in cols.items()]) for df, cols in parts]
    return reduce(lambda a, b: a.unionByName(b), shaped)


def union_ids(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames).distinct()


def intersect_ids(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def dedupe(df: DataFrame, keys: list[str], keep_order=None) -> DataFrame:
    """One row per key: any, or the first in ``keep_order``."""
    return df.dropDuplicates(keys) if keep_order is None else first_of_key(df, keys, keep_order)
