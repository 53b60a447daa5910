"""Mutations as snapshot transforms: a frame in, the next version out.

Changes and deletions are always limited to rows of the caller's tenant; new
rows get that tenant unless they bring one.  Refused rows come back in a frame of
their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegov.operators.ordering import number_rows
from tablegov.session import sized
from tablegov.spec import DISABLED, ENABLED, Ctx, TableSpec


def _now(now: str | None, df: DataFrame, column: str) -> Column:
    dtype = df.schema[column].dataType
    return (F.lit(now) if now else F.current_timestamp()).cast(dtype)


def writable(spec: TableSpec, ctx: Ctx) -> Column:
    if not spec.tenant or ctx.is_super or ctx.tenant_id is None:
        return F.lit(True)
    return F.col(spec.tenant) == ctx.tenant_id


def _in(df: DataFrame, ids, key: str) -> DataFrame:
    """``df`` with ``_hit``; ``ids`` is a Python list or a one-column frame."""
    if isinstance(ids, DataFrame):
        hits = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
    else:
        dtype = df.schema[key].dataType.simpleString()
        rows = [(i,) for i in set(ids)]
        hits = sized(df.sparkSession.createDataFrame(rows, f"`{key}` {dtype}"), len(rows))
    return df.join(hits.withColumn("_hit", F.lit(True)), key, "left").withColumn(
        "_hit", F.coalesce("_hit", F.lit(False)))


def create(df: DataFrame, rows: DataFrame, spec: TableSpec, ctx: Ctx, order, now: str | None = None) -> DataFrame:
    """``df`` plus new rows with ids after the largest one, defaults, tenant,
    stamps and owner.  The numbering is split over ranges, not one task."""
    start = F.coalesce(df.agg(F.max(spec.key)).scalar(), F.lit(0))
    new = number_rows(rows, order, "_n").withColumn(spec.key, (start + F.col("_n")).cast(df.schema[spec.key].dataType))
    stamp = {
        spec.status: F.lit(ENABLED), spec.created_time: None, spec.updated_time: None, spec.deleted: F.lit(False),
        spec.tenant: F.lit(ctx.tenant_id), spec.creator: F.lit(ctx.user_id), spec.updater: F.lit(ctx.user_id),
    }
    for column, value in {**{k: F.lit(v) for k, v in spec.defaults.items()}, **stamp}.items():
        if not column or column not in df.columns:
            continue
        default = _now(now, df, column) if column in (spec.created_time, spec.updated_time) else value
        default = default.cast(df.schema[column].dataType)
        new = new.withColumn(column, F.coalesce(F.col(column), default) if column in new.columns else default)
    for column in df.columns:
        if column == "uuid" and column not in new.columns:
            new = new.withColumn("uuid", F.uuid())
        elif column not in new.columns:
            new = new.withColumn(column, F.lit(None).cast(df.schema[column].dataType))
    return df.unionByName(new.select(*df.columns))


def _live(df: DataFrame, spec: TableSpec) -> Column:
    if spec.deleted and spec.deleted in df.columns:
        return ~F.coalesce(F.col(spec.deleted).cast("boolean"), F.lit(False))
    return F.lit(True)


def folded(rows: DataFrame, keys: list[str], fields: list[str], order: str) -> DataFrame:
    """One row per key: of every field the last value that is not null, as if the
    rows were written one after another in ``order``."""
    return rows.groupBy(*keys).agg(F.max(order).alias(order), *[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields])


def refusal(df: DataFrame, spec: TableSpec, ctx: Ctx, scope: Column | None = None) -> Column:
    """Why a row may not be changed by the caller, or null: another tenant's,
    deleted, or outside the caller's data ``scope`` (a predicate on the row)."""
    live = _live(df, spec)
    inside = F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))
    return F.when(~F.coalesce(writable(spec, ctx), F.lit(False)), "foreign_tenant").when(~live, "deleted").when(
        ~inside, "out_of_scope")


def update(df: DataFrame, changes: DataFrame, spec: TableSpec, ctx: Ctx, now: str | None = None,
           scope: Column | None = None, given: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Partial update by key of the rows the caller may change.  A null in
    ``changes`` leaves a field alone, except for the fields in ``given``, which
    it clears.  A key that ``changes`` holds more than once is refused, as no
    order says which change is meant.  Returns the new version and the refused
    changes with a reason."""
    fields = [c for c in changes.columns if c != spec.key]
    once = changes.groupBy(spec.key).agg(F.count(F.lit(1)).alias("_times"), *[
        F.any_value(c).alias(f"_new_{c}") for c in fields])
    joined = df.join(once, spec.key, "left")
    out = joined.withColumn("_ok", F.coalesce(F.col("_times") == 1, F.lit(False)) & refusal(df, spec, ctx, scope).isNull())
    for c in fields:
        new = F.col(f"_new_{c}") if c in (given or []) else F.coalesce(f"_new_{c}", c)
        out = out.withColumn(c, F.when(F.col("_ok"), new).otherwise(F.col(c)))
    out = _stamp(out, df, spec, ctx, F.col("_ok"), now)
    have = df.select(spec.key, refusal(df, spec, ctx, scope).alias("_why"), F.lit(True).alias("_found"))
    times = once.select(spec.key, "_times")
    refused = changes.join(times, spec.key).join(have, spec.key, "left").withColumn(
        "reason", F.when(F.col("_found").isNull(), "not_found").when(F.col("_why").isNotNull(), F.col("_why")).when(
            F.col("_times") > 1, "repeated"))
    return out.select(*df.columns), refused.filter("reason is not null").drop("_why", "_found", "_times")


def _stamp(out: DataFrame, df: DataFrame, spec: TableSpec, ctx: Ctx, hit: Column, now: str | None) -> DataFrame:
    if spec.updated_time and spec.updated_time in df.columns:
        out = out.withColumn(spec.updated_time, F.when(hit, _now(now, df, spec.updated_time)).otherwise(
            F.col(spec.updated_time)))
    if spec.updater and spec.updater in df.columns:
        by = F.lit(ctx.user_id).cast(df.schema[spec.updater].dataType)
        out = out.withColumn(spec.updater, F.when(hit, by).otherwise(F.col(spec.updater)))
    return out


def set_values(df: DataFrame, ids, values: dict, spec: TableSpec, ctx: Ctx) -> DataFrame:
    marked = _in(df, ids, spec.key)
    hit = F.col("_hit") & writable(spec, ctx)
    for column, value in values.items():
        marked = marked.withColumn(column, F.when(hit, F.lit(value).cast(df.schema[column].dataType)).otherwise(
            F.col(column)))
    return marked.select(*df.columns)


def toggle(df: DataFrame, column: str, ids, spec: TableSpec, ctx: Ctx) -> DataFrame:
    marked = _in(df, ids, spec.key)
    flipped = F.when(F.col(column) == ENABLED, DISABLED).otherwise(ENABLED)
    return marked.withColumn(column, F.when(F.col("_hit") & writable(spec, ctx), flipped).otherwise(
        F.col(column))).select(*df.columns)


def _deletion(df: DataFrame, spec: TableSpec, hit: Column, deleted, when: Column, by: Column) -> DataFrame:
    # ``hit`` may look at the flag itself, so it is fixed before the flag moves.
    out = df.withColumn("_hit", hit)
    out = out.withColumn(spec.deleted, F.when(F.col("_hit"), F.lit(deleted)).otherwise(F.col(spec.deleted)))
    out = out.withColumn(spec.deleted_time, F.when(F.col("_hit"), when).otherwise(F.col(spec.deleted_time)))
    return out.withColumn(spec.deleted_id, F.when(F.col("_hit"), by).otherwise(F.col(spec.deleted_id))).drop("_hit")


def soft_delete(df: DataFrame, ids, spec: TableSpec, ctx: Ctx, now: str | None = None) -> DataFrame:
    """Flag, time and actor where the table has all three columns; otherwise
    the rows are gone."""
    marked = _in(df, ids, spec.key)
    hit = F.col("_hit") & writable(spec, ctx)
    if not spec.soft_deletes:
        return marked.filter(~hit).select(*df.columns)
    by = F.lit(ctx.user_id).cast(df.schema[spec.deleted_id].dataType)
    return _deletion(marked, spec, hit, True, _now(now, df, spec.deleted_time), by).select(*df.columns)


def restore(df: DataFrame, ids, spec: TableSpec, ctx: Ctx) -> DataFrame:
    if not spec.soft_deletes:
        raise ValueError(f"{spec.name} does not support restore")
    marked = _in(df, ids, spec.key)
    hit = F.col("_hit") & writable(spec, ctx)
    nulls = [F.lit(None).cast(df.schema[c].dataType) for c in (spec.deleted_time, spec.deleted_id)]
    return _deletion(marked, spec, hit, False, *nulls).select(*df.columns)


def clear(df: DataFrame, spec: TableSpec, ctx: Ctx, now: str | None = None) -> DataFrame:
    """Delete every row of the tenant, softly where the table can; rows deleted
    before get the new time and actor."""
    hit = writable(spec, ctx)
    if not spec.soft_deletes:
        return df.filter(~hit)
    by = F.lit(ctx.user_id).cast(df.schema[spec.deleted_id].dataType)
    return _deletion(df, spec, hit, True, _now(now, df, spec.deleted_time), by)


def upsert(df: DataFrame, rows: DataFrame, keys: list[str], defaults: dict | None = None,
           spec: TableSpec | None = None, ctx: Ctx | None = None, order: str | None = None) -> DataFrame:
    """Update by key or insert.  A null field in ``rows`` keeps the old value,
    or takes the default on insert.  The rows of a repeated key are applied one
    after another by the column ``order``; without it there is no last row, and
    the one with the largest fields counts.  With ``spec`` and ``ctx`` rows of other tenants stay as they
    are, and a row that names another tenant is not inserted."""
    fields = [c for c in df.columns if c not in keys]
    if spec and ctx and spec.tenant and not ctx.is_super and ctx.tenant_id is not None:
        foreign = df.filter(~F.coalesce(writable(spec, ctx), F.lit(False)))
        own = df.filter(writable(spec, ctx))
        if spec.tenant in rows.columns:
            rows = rows.filter(F.coalesce(F.col(spec.tenant) == ctx.tenant_id, F.lit(True)))
        rows = rows.withColumn(spec.tenant, F.lit(ctx.tenant_id).cast(df.schema[spec.tenant].dataType))
        fresh = rows if spec.tenant in keys else rows.join(foreign.select(*keys), keys, "left_anti")
        return upsert(own, fresh, keys, defaults, order=order).unionByName(foreign)
    brought = [c for c in fields if c in rows.columns]
    if order:
        rows = folded(rows, keys, brought, order).select(*keys, *brought)
    elif brought:
        best = F.max(F.struct(*brought)).alias("_best")
        rows = rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in brought])
    else:
        rows = rows.select(*keys).distinct()
    new = rows.select(*keys, *[(F.col(c) if c in rows.columns else F.lit(None).cast(df.schema[c].dataType)).alias(
        f"_new_{c}") for c in fields])
    joined = df.join(new, keys, "full")
    merged = [F.coalesce(F.col(f"_new_{c}"), F.col(c), F.lit((defaults or {}).get(c))).cast(
        df.schema[c].dataType).alias(c) for c in fields]
    return joined.select(*keys, *merged).select(*df.columns)


def import_upsert(df: DataFrame, rows: DataFrame, key: str, update_support: bool, spec: TableSpec, ctx: Ctx,
                  protected: Column | None = None, row_no: str = "row_no", now: str | None = None,
                  ) -> tuple[DataFrame, DataFrame]:
    """Import by natural key: known rows are updated or reported as existing,
    protected rows are refused, the rest is created.  When a key occurs more
    than once the rows are written one after another: the first creates, the
    later ones meet an existing row, and a null never takes a value away.  A key
    that only a deleted row has is reported as ``deleted`` and left alone.
    Only rows of the caller's tenant are looked up and changed, and the tenant
    itself cannot be imported.  Returns the new version and the report
    ``(row_no, key, outcome)``."""
    fields = [c for c in rows.columns if c not in (key, row_no, spec.tenant)]
    live = _live(df, spec)
    known = df.filter(writable(spec, ctx)).groupBy(key).agg(
        F.max(live).alias("_known"), F.max(F.lit(False) if protected is None else protected & live).alias("_protected"))
    first = rows.groupBy(key).agg(F.min(row_no).alias("_first"))
    marked = rows.join(first, key).join(known, key, "left")
    outcome = (
        F.when(~F.col("_known"), "deleted")
        .when(F.col("_protected"), "refused")
        .when(F.col("_known").isNull() & (F.col(row_no) == F.col("_first")), "created")
        .otherwise("updated" if update_support else "exists")
    )
    marked = marked.withColumn("outcome", outcome)
    report = marked.select(row_no, key, "outcome")
    accepted = folded(marked.filter(F.col("outcome").isin("created", "updated")), [key, "_known"], fields, row_no)
    fresh = accepted.filter(F.col("_known").isNull()).select(key, *fields, row_no)
    changes = accepted.filter(F.col("_known")).select(key, *[F.col(c).alias(f"_new_{c}") for c in fields])
    out = df.join(changes.withColumn("_hit", F.lit(True)), key, "left").withColumn(
        "_hit", F.coalesce(F.col("_hit") & writable(spec, ctx) & live, F.lit(False)))
    for c in fields:
        out = out.withColumn(c, F.when(F.col("_hit"), F.coalesce(F.col(f"_new_{c}"), F.col(c))).otherwise(F.col(c)))
    out = _stamp(out, df, spec, ctx, F.col("_hit"), now).select(*df.columns)
    return create(out, fresh.drop(row_no).withColumn("_order", F.col(key)), spec, ctx, ["_order"], now), report


def exclusive_default(links: DataFrame, user_id, link_id, user="user_id", key="id", flag="is_default") -> DataFrame:
    """The given link becomes the user's only default."""
    return links.withColumn(flag, F.when(F.col(user) == user_id, F.col(key) == link_id).otherwise(F.col(flag)))


def first_default(links: DataFrame, user="user_id", key="id", flag="is_default") -> DataFrame:
    """Users without a default get their first link as default.  Both facts come
    from one aggregate that combines before the shuffle."""
    facts = links.groupBy(user).agg(F.max(flag).alias("_any"), F.min(key).alias("_first"))
    joined = links.join(facts, user)
    return joined.withColumn(flag, F.col(flag) | (~F.col("_any") & (F.col(key) == F.col("_first")))).select(
        *links.columns)


def backfill(df: DataFrame, column: str, value) -> DataFrame:
    """Null or zero becomes ``value``."""
    return df.withColumn(column, F.when(F.col(column).isNull() | (F.col(column) == 0), F.lit(value)).otherwise(
        F.col(column)).cast(df.schema[column].dataType))


# Days before expiry at which a notice is due, nearest first.
NOTICE_DAYS = [1, 7, 30]


def expire(df: DataFrame, now: str, status="status", end="end_time", days=NOTICE_DAYS) -> DataFrame:
    """Enabled rows past their end are disabled; others near it get the nearest
    ``notice_days``."""
    at = F.lit(now).cast(df.schema[end].dataType)
    live = (F.col(status) == ENABLED) & F.col(end).isNotNull()
    over = live & (F.col(end) <= at)
    notice = F.when(~live | over, F.lit(None).cast("int"))
    for d in days:
        notice = notice.when(F.col(end) <= at + F.expr(f"interval {int(d)} days"), F.lit(d))
    return df.withColumn("notice_days", notice).withColumn(
        status, F.when(over, F.lit(DISABLED)).otherwise(F.col(status)))


def retain(df: DataFrame, ts: str, days: int, now: str) -> DataFrame:
    """Rows younger than the retention; the bound is a literal, so files and
    partitions are skipped."""
    return df.filter(F.col(ts) >= F.lit(now).cast(df.schema[ts].dataType) - F.expr(f"interval {int(days)} days"))


def rename_propagate(child: DataFrame, renames: DataFrame, column: str, status: str | None = None) -> DataFrame:
    """Child rows follow a parent's new key: ``renames(old, new[, status])``."""
    side = renames.select(F.col("old").alias(column), F.col("new").alias("_new"),
                          *([F.col("status").alias("_status")] if status else []))
    out = child.join(side, column, "left").withColumn("_key", F.coalesce("_new", column))
    if status:
        out = out.withColumn(status, F.coalesce("_status", status))
    return out.select(*[F.col("_key").alias(c) if c == column else F.col(c) for c in child.columns])


def cancel_pending(jobs: DataFrame, status="status") -> DataFrame:
    return jobs.withColumn(status, F.when(F.col(status) == "pending", "cancelled").otherwise(F.col(status)))


def guarded_delete(df: DataFrame, ids, rules: list[tuple[Column, str]], spec: TableSpec, ctx: Ctx,
                   ) -> tuple[DataFrame, DataFrame]:
    """Delete the ids of the caller's tenant that no rule protects.  The second
    frame names the others with the first rule that held."""
    rules = [(~F.coalesce(writable(spec, ctx), F.lit(False)), "foreign_tenant"), *rules]
    reason = F.lit(None).cast("string")
    for cond, name in reversed(rules):
        reason = F.when(cond, F.lit(name)).otherwise(reason)
    marked = _in(df, ids, spec.key).withColumn("reason", F.when(F.col("_hit"), reason))
    kept = marked.filter(~F.col("_hit") | F.col("reason").isNotNull()).select(*df.columns)
    return kept, marked.filter(F.col("reason").isNotNull()).select(spec.key, "reason")


def replace_children(links: DataFrame, owner: str, owners: DataFrame, new: DataFrame,
                     spec: TableSpec | None = None, ctx: Ctx | None = None) -> DataFrame:
    """The links of ``owners`` (one column) are replaced by ``new``; an owner
    without new rows ends up with none.  With ``spec`` and ``ctx``, ``owners``
    is the governed table of owners, and those of other tenants are left out."""
    if spec and ctx:
        owners = owners.filter(refusal(owners, spec, ctx).isNull()).select(spec.key)
    gone = owners.select(F.col(owners.columns[0]).alias(owner))
    kept = links.join(gone, owner, "left_anti").select(*links.columns)
    return kept.unionByName(new.join(gone, owner, "left_semi").select(*links.columns))


def last_owner_guard(links: DataFrame, removals: DataFrame, tenant="tenant_id", user="user_id",
                     owner="is_owner") -> DataFrame:
    """Tenants the removals would leave without an owner."""
    gone = removals.select(tenant, user).distinct().withColumn("_gone", F.lit(True))
    marked = links.join(gone, [tenant, user], "left")
    hit = F.coalesce("_gone", F.lit(False))
    left = marked.groupBy(tenant).agg(
        F.count_if(F.col(owner) & ~hit).alias("owners_left"),
        F.count_if(F.col(owner) & hit).alias("owners_removed"))
    return left.filter("owners_left < 1 and owners_removed > 0")
