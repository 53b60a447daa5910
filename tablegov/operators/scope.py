"""Row-level governance: tenants, data scopes, granted menus and roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegov.operators.conditions import not_deleted, where
from tablegov.operators.tree import descendants
from tablegov.session import sized
from tablegov.spec import (
    ENABLED, PLATFORM_TENANT, SCOPE_ALL, SCOPE_CUSTOM, SCOPE_DEPT, SCOPE_DEPT_AND_CHILDREN,
    Ctx, TableSpec,
)


def tenant_filter(df: DataFrame, spec: TableSpec, ctx: Ctx, reading: bool = True) -> DataFrame:
    """Rows of the caller's tenant; a superuser or a call without tenant sees
    all.  A shared table also shows the platform tenant's rows to readers."""
    if not spec.tenant or spec.tenant not in df.columns or ctx.is_super or ctx.tenant_id is None:
        return df
    own = F.col(spec.tenant) == ctx.tenant_id
    if reading and spec.platform_shared and ctx.tenant_id != PLATFORM_TENANT:
        own = own | (F.col(spec.tenant) == PLATFORM_TENANT)
    return df.filter(own)


def scope_self(df: DataFrame, spec: TableSpec, ctx: Ctx) -> DataFrame:
    if not spec.creator or spec.creator not in df.columns or ctx.user_id is None:
        return df
    return df.filter(F.col(spec.creator) == ctx.user_id)


def visible_depts(ctx: Ctx, depts: DataFrame, id="id", parent="parent_id") -> DataFrame | None:
    """Departments the caller's roles open, as a one-column frame; ``None`` when
    they open none."""
    fixed = set()
    if SCOPE_CUSTOM in ctx.scopes:
        fixed |= ctx.custom_depts
    if SCOPE_DEPT in ctx.scopes and ctx.dept_id is not None:
        fixed.add(ctx.dept_id)
    dtype = depts.schema[id].dataType.simpleString()
    listed = None
    if fixed:
        rows = depts.sparkSession.createDataFrame([(d,) for d in fixed], f"dept_id {dtype}")
        listed = sized(rows, len(fixed))
    if SCOPE_DEPT_AND_CHILDREN not in ctx.scopes or ctx.dept_id is None:
        return listed
    start = depts.sparkSession.createDataFrame([(ctx.dept_id,)], f"id {dtype}")
    subtree = descendants(depts, start, id, parent).select(F.col("id").alias("dept_id"))
    return sized(subtree if listed is None else subtree.unionByName(listed).distinct())


def creator_in(df: DataFrame, users: DataFrame, depts: DataFrame, creator="created_id",
               user_id="id", user_dept="dept_id") -> DataFrame:
    """Rows whose creator works in one of ``depts`` (one-column frame)."""
    wanted = depts.select(F.col(depts.columns[0]).alias("_dept"))
    members = users.select(F.col(user_id).alias(creator), F.col(user_dept).alias("_dept")).join(
        wanted, "_dept", "left_semi")
    return df.join(members.select(creator), creator, "left_semi").select(*df.columns)


def _unrestricted(ctx: Ctx) -> bool:
    return ctx.user_id is None or not ctx.check_data_scope or ctx.is_super


def scope_rows(df: DataFrame, spec: TableSpec, ctx: Ctx, users: DataFrame, depts: DataFrame) -> DataFrame:
    """Default data scope.  Roles are united; "all" wins; departments beat
    "self"; no opened department falls back to the caller's own rows."""
    if _unrestricted(ctx) or not spec.creator or spec.creator not in df.columns:
        return df
    if not ctx.roles:
        return scope_self(df, spec, ctx)
    if SCOPE_ALL in ctx.scopes:
        return df
    opened = visible_depts(ctx, depts)
    if opened is None:
        return scope_self(df, spec, ctx)
    if spec.dept and spec.dept in df.columns:
        return df.join(opened.select(F.col("dept_id").alias(spec.dept)), spec.dept, "left_semi").select(*df.columns)
    return creator_in(df, users, opened, spec.creator)


def scope_dept(df: DataFrame, ctx: Ctx, depts: DataFrame, column: str = "id",
               own_fallback: bool = True) -> DataFrame:
    """Department-based tables: the department table by its id, the user table
    by its department column (``own_fallback=False``)."""
    if _unrestricted(ctx) or SCOPE_ALL in ctx.scopes:
        return df
    own = df.filter(F.col(column) == ctx.dept_id) if ctx.dept_id is not None else df
    if not ctx.roles:
        return own if own_fallback else df
    opened = visible_depts(ctx, depts)
    if opened is None:
        return own if own_fallback else df
    return df.join(opened.select(F.col("dept_id").alias(column)), column, "left_semi").select(*df.columns)


def _role_ids(df: DataFrame, ctx: Ctx) -> DataFrame:
    rows = df.sparkSession.createDataFrame([(r.id,) for r in ctx.roles], "role_id bigint")
    return sized(rows, len(ctx.roles))


def scope_menu(df: DataFrame, ctx: Ctx, role_menus: DataFrame, id="id", status="status") -> DataFrame:
    """Enabled menus granted by any of the caller's roles."""
    if _unrestricted(ctx):
        return df
    if not ctx.roles:
        return df.filter(F.lit(False))
    granted = role_menus.join(_role_ids(df, ctx), "role_id", "left_semi").select(F.col("menu_id").alias(id))
    return df.filter(F.col(status) == ENABLED).join(granted, id, "left_semi").select(*df.columns)


def scope_role(df: DataFrame, ctx: Ctx, id="id") -> DataFrame:
    """Only the roles bound to the caller."""
    if _unrestricted(ctx):
        return df
    if not ctx.roles:
        return df.filter(F.lit(False))
    return df.filter(F.col(id).isin([r.id for r in ctx.roles]))


def read_governed(df: DataFrame, spec: TableSpec, ctx: Ctx, search: dict | None, users: DataFrame,
                  depts: DataFrame, include_deleted: bool = False) -> DataFrame:
    """Soft delete, tenant, search and data scope in one lazy frame; the cheap
    filters come first and reach the scan."""
    out = df
    if spec.deleted and spec.deleted in df.columns and not include_deleted:
        out = not_deleted(out, spec.deleted)
    out = tenant_filter(out, spec, ctx)
    out = where(out, search)
    return scope_rows(out, spec, ctx, users, depts)


# --- permissions --------------------------------------------------------------

def grants(user_roles: DataFrame, roles: DataFrame, role_menus: DataFrame, menus: DataFrame,
           user_id=None) -> DataFrame:
    """Distinct ``(user_id, permission)`` through enabled roles and menus, for
    one user where ``user_id`` is given.  Role permissions are made distinct
    before they meet the users."""
    if user_id is not None:
        user_roles = user_roles.filter(F.col("user_id") == user_id)
        role_menus = role_menus.join(user_roles.select("role_id"), "role_id", "left_semi")
    live_menus = menus.filter((F.col("status") == ENABLED) & F.col("permission").isNotNull())
    per_role = role_menus.join(live_menus.select(F.col("id").alias("menu_id"), "permission"), "menu_id")
    per_role = per_role.select("role_id", "permission").distinct()
    live_roles = roles.filter(F.col("status") == ENABLED).select(F.col("id").alias("role_id"))
    held = user_roles.join(live_roles, "role_id", "left_semi").select("user_id", "role_id").distinct()
    return held.join(per_role, "role_id").select("user_id", "permission").distinct()


def has_permission(users: DataFrame, required: list[str], user_roles: DataFrame, roles: DataFrame,
                   role_menus: DataFrame, menus: DataFrame, superuser="is_superuser") -> DataFrame:
    """Users who hold any required permission.  No requirement or a wildcard
    among them lets everyone pass, as does being a superuser.  Semi-joins keep
    the work at one row per menu, role and user."""
    if not required or {"*", "*:*:*"} & set(required):
        return users
    fitting = menus.filter((F.col("status") == ENABLED) & F.col("permission").isin(required))
    opening = role_menus.join(fitting.select(F.col("id").alias("menu_id")), "menu_id", "left_semi")
    live_roles = roles.filter(F.col("status") == ENABLED).select(F.col("id").alias("role_id"))
    live_roles = live_roles.join(opening, "role_id", "left_semi")
    held = user_roles.join(live_roles, "role_id", "left_semi").select(F.col("user_id").alias("id")).distinct()
    marked = users.join(held.withColumn("_held", F.lit(True)), "id", "left")
    return marked.filter(F.col(superuser) | F.col("_held")).select(*users.columns)
