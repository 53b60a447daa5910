"""Relationship enrichment.

No join is hinted: Spark broadcasts a side when its measured size is below
``spark.sql.autoBroadcastJoinThreshold`` and shuffles (splitting skewed
partitions) otherwise.  Nested children are split into chunks, so that a
parent with very many children becomes several bounded rows instead of one
unbounded array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegov.operators.ordering import normalise, number_rows
from tablegov.session import cut
from tablegov.spec import ENABLED

# Children per nested array.
CHUNK = 10_000

# Pairs of one join value above which ``spread_join`` deals it over several cells, the most
# cells, the pairs of one task, and the rows of one side that are unpacked together.
PAIRS = 2_000_000
MOST_CELLS = 128
PAIRS_PER_TASK = 50_000_000
RUN = 64


def with_one(df: DataFrame, ref: DataFrame, fk: str, name: str, key="id", fields=("id", "name")) -> DataFrame:
    """Attach ``name`` as a struct of the referenced row, null when absent."""
    side = ref.select(F.col(key).alias("_ref"), F.struct(*[F.col(c) for c in fields]).alias(name))
    return df.join(side, F.col(fk) == F.col("_ref"), "left").drop("_ref")


def page_with_one(items: DataFrame, ref: DataFrame, fk: str, name: str, key="id", fields=("id", "name")) -> DataFrame:
    """``with_one`` for one page of rows.  The page is computed once, then only
    the referenced rows are picked out of ``ref`` before the join, so that a
    large ``ref`` is scanned but never shuffled.  Both broadcasts are bounded by
    the page size."""
    page = cut(items)
    wanted = page.select(F.col(fk).alias(key)).distinct()
    side = ref.join(F.broadcast(wanted), key, "left_semi")
    return with_one(page, F.broadcast(side), fk, name, key, fields)


def child_chunks(child: DataFrame, fk: str, by, fields: list[str], chunk: int = CHUNK) -> DataFrame:
    """``(fk, chunk_no, children, chunk_rows)``: the children of each parent in
    order, at most ``chunk`` per row.  ``by`` must end in a unique column."""
    numbered = number_rows(child.filter(F.col(fk).isNotNull()), by, "_pos", keys=[fk])
    item = F.struct("_pos", *[F.col(c) for c in fields])
    part = numbered.withColumn("chunk_no", F.floor((F.col("_pos") - 1) / chunk)).groupBy(fk, "chunk_no").agg(
        F.array_sort(F.collect_list(item)).alias("_items"))
    strip = F.transform("_items", lambda i: F.struct(*[i[c].alias(c) for c in fields]))
    return part.select(fk, "chunk_no", strip.alias("children"), F.size("_items").alias("chunk_rows"))


def with_many(df: DataFrame, child: DataFrame, fk: str, by, fields: list[str], name: str = "children",
              key="id", chunk: int = CHUNK) -> DataFrame:
    """Parents with their ordered children.  A parent without children gets an
    empty array; one with more than ``chunk`` continues in further rows
    (``chunk_no`` 1, 2, ...)."""
    nested = child_chunks(child, fk, by, fields, chunk).select(
        F.col(fk).alias(key), "chunk_no", F.col("children").alias(name))
    out = df.join(nested, key, "left")
    return out.withColumn("chunk_no", F.coalesce("chunk_no", F.lit(0))).withColumn(
        name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))


def with_bridge(df: DataFrame, bridge: DataFrame, ref: DataFrame, left: str, right: str, by,
                fields: list[str], name: str, key="id", ref_key="id", chunk: int = CHUNK) -> DataFrame:
    """Many-to-many nest through a bridge of ``(left, right)`` pairs."""
    pairs = bridge.select(left, right).distinct()
    side = ref.select(F.col(ref_key).alias(right), *[F.col(c).alias(f"_f_{c}") for c in ref.columns])
    linked = pairs.join(side, right).select(left, *[F.col(f"_f_{c}").alias(c) for c in ref.columns])
    return with_many(df, linked, left, normalise(by), fields, name, key, chunk)


def tenant_users(links: DataFrame, users: DataFrame, tenant_id) -> DataFrame:
    """Members of one tenant, default links first."""
    rows = links.filter(F.col("tenant_id") == tenant_id).join(
        users.select(F.col("id").alias("user_id"), "name", "status"), "user_id")
    return rows.orderBy(F.col("is_default").desc(), F.col("user_id"))


def tenant_options(links: DataFrame, tenants: DataFrame, user_id, is_super: bool = False) -> DataFrame:
    """Enabled tenants a user may enter; a superuser gets every one."""
    live = tenants.filter((F.col("status") == ENABLED) & ~F.col("is_deleted"))
    if is_super:
        return live.orderBy("sort", "id").select("id", "name")
    mine = links.filter(F.col("user_id") == user_id).select(F.col("tenant_id").alias("id"), "is_default")
    return live.join(mine, "id").orderBy(F.col("is_default").desc(), "sort", "id").select("id", "name", "is_default")


def installed(items: DataFrame, links: DataFrame, item_fk: str, by, key="id") -> DataFrame:
    """Items joined to their installation rows."""
    from tablegov.operators.page import order

    side = links.select(F.col(item_fk).alias(key), *[c for c in links.columns if c != item_fk])
    return order(items.join(side, key), by)


def flag_membership(df: DataFrame, other: DataFrame, key: str, name: str = "installed") -> DataFrame:
    """Boolean column: does the row's key occur in ``other`` (one column)?"""
    hits = other.select(F.col(other.columns[0]).alias(key)).distinct().withColumn(name, F.lit(True))
    return df.join(hits, key, "left").withColumn(name, F.col(name).isNotNull())


def spread_join(left: DataFrame, right: DataFrame, on: str, condition: Column | None = None) -> DataFrame:
    """Inner join on ``on`` where few values may have very many rows on both sides.
    The pairs are counted first.  If they are many, both sides of a value are dealt over
    a grid of cells by a hash of their rows, and a row is repeated for each part of the
    other side, so about as often as the square root of the cells.  The pairs themselves
    are never shuffled.  A cell makes them run by run: rows that follow each other have
    one row of the left and ``RUN`` rows of the right at most, over and over, which a
    columnar file stores in few bits."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(on).agg(F.count(F.lit(1)).alias(name))

    n = F.col("__left") * F.col("__right")
    sizes = counted(left, "__left").join(counted(right, "__right"), on).agg(
        F.sum(n.cast("double")), F.max(n), F.sum("__left"), F.sum("__right")).first()
    pairs, largest, many_left, many_right = (x or 0 for x in sizes)
    if largest <= PAIRS:
        joined = left.join(right, on)
        return joined if condition is None else joined.filter(condition)
    cells = min(MOST_CELLS, -(-largest // PAIRS))
    across = max(1, min(cells, round((cells * many_right / many_left) ** 0.5)))
    down = -(-cells // across)
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs // PAIRS_PER_TASK) + 1)
    keys = [on, "__down", "__across"]

    def runs(df: DataFrame, own: str, parts: int, other: str, copies: int, name: str) -> DataFrame:
        """A row per run of one cell's rows."""
        fields = [F.lit(True).alias("__row"), *[F.col(c) for c in df.columns if c != on]]
        dealt = df.where(F.col(on).isNotNull()).withColumn(
            own, F.pmod(F.xxhash64(*df.columns), F.lit(parts)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).repartition(tasks, *keys)
        return dealt.sortWithinPartitions(*keys).withColumn(
            "__run", F.floor(F.monotonically_increasing_id() / RUN)).groupBy(*keys, "__run").agg(
            F.collect_list(F.struct(*fields)).alias(name)).drop("__run")

    cell = runs(left, "__down", down, "__across", across, "__lefts").join(
        runs(right, "__across", across, "__down", down, "__rights"), keys)
    joined = cell.select(on, "__rights", F.inline("__lefts")).drop("__row").select(
        on, *[c for c in left.columns if c != on], F.inline("__rights")).drop("__row")
    return joined if condition is None else joined.filter(condition)


def describe_tables(tables: DataFrame, namespaces: DataFrame, comments: DataFrame) -> DataFrame:
    """Catalog rows with namespace and comment, empty text where none.  Comments
    come first, while a table is still one row."""
    described = tables.join(comments, "table_id", "left").withColumn("comment", F.coalesce("comment", F.lit("")))
    return spread_join(described, namespaces, "namespace_id").select(
        *dict.fromkeys(["table_id", "namespace_id", *tables.columns, *namespaces.columns, *comments.columns]))


def insert_missing(target: DataFrame, source: DataFrame, keys: list[str], other: DataFrame | None = None,
                   on: str | None = None) -> DataFrame:
    """``target`` plus the source rows whose key it lacks.  With ``other`` the
    source rows are the distinct pairs of a key of ``source`` and one of ``other``
    that share a value of ``on``; ``keys`` names the two columns, that of ``source``
    first.  The pairs may be far more than the rows of both: they are told apart
    from repeated ones and from those of ``target`` where they are made."""
    if other is None:
        return target.unionByName(source.join(target.select(*keys), keys, "left_anti").select(*target.columns))
    mine, its = keys

    def by_value(df: DataFrame, key: str, name: str) -> DataFrame:
        """A row per key and value, with all values of the key."""
        grouped = df.groupBy(key).agg(F.collect_set(on).alias(name))
        return grouped.withColumn(on, F.explode(name))

    left, right = by_value(source, mine, "__mine"), by_value(other, its, "__its")
    # A pair that shares several values is made at the least of them.
    once = (F.size("__mine") == 1) | (F.size("__its") == 1) | (
        F.array_min(F.array_intersect("__mine", "__its")) == F.col(on))
    taken = target.select(*keys).distinct().join(right.select(its, on), its).groupBy(mine, on).agg(
        F.collect_list(its).alias("__taken"))
    left = left.join(taken, [mine, on], "left")
    free = F.col("__taken").isNull() | F.coalesce(~F.array_contains("__taken", F.col(its)), F.lit(True))
    pairs = spread_join(left, right, on, once & free)
    return target.unionByName(pairs.select(*target.columns))


def with_parent_name(df: DataFrame, id="id", parent="parent_id", name="name") -> DataFrame:
    above = df.select(F.col(id).alias("_pid"), F.col(name).alias("parent_name"))
    return df.join(above, F.col(parent) == F.col("_pid"), "left").drop("_pid")


def resolve_fk(df: DataFrame, ref: DataFrame, natural: str, surrogate: str = "id",
               ref_natural: str | None = None, name: str = "ref_id") -> tuple[DataFrame, DataFrame]:
    """Attach the surrogate id found by natural key, the smallest where a key
    repeats; unmatched rows go to the second frame."""
    side = ref.groupBy(F.col(ref_natural or natural).alias(natural)).agg(F.min(surrogate).alias(name))
    return df.join(side, natural), df.join(side, natural, "left_anti")


def granted_menus(user_roles: DataFrame, role_menus: DataFrame, menus: DataFrame, allowed: DataFrame | None,
                  users: DataFrame, user_id=None) -> DataFrame:
    """Distinct ``(user_id, menu_id)`` a user can open: granted through roles,
    enabled, a page or directory, on the pc terminal, and in the tenant's
    allowed ``(tenant_id, menu_id)`` set where the tenant has one.  ``user_id``
    asks for one user."""
    if user_id is not None:
        user_roles = user_roles.filter(F.col("user_id") == user_id)
        role_menus = role_menus.join(user_roles.select("role_id"), "role_id", "left_semi")
    open_menus = menus.filter(
        (F.col("status") == ENABLED) & F.col("type").isin(1, 2, 4) & (F.coalesce("client", F.lit("pc")) == "pc"))
    per_role = role_menus.join(open_menus.select(F.col("id").alias("menu_id")), "menu_id", "left_semi")
    rows = user_roles.select("user_id", "role_id").distinct().join(
        per_role.select("role_id", "menu_id").distinct(), "role_id").select("user_id", "menu_id").distinct()
    if allowed is None:
        return rows
    owner = users.select(F.col("id").alias("user_id"), "tenant_id")
    limited = allowed.select("tenant_id").distinct().withColumn("_limited", F.lit(True))
    inside = allowed.select("tenant_id", "menu_id").distinct().withColumn("_inside", F.lit(True))
    marked = rows.join(owner, "user_id", "left").join(limited, "tenant_id", "left").join(
        inside, ["tenant_id", "menu_id"], "left")
    return marked.filter(F.col("_limited").isNull() | F.col("_inside")).select("user_id", "menu_id")


def session_dept(sessions: DataFrame, depts: DataFrame, team: str = "team_id") -> DataFrame:
    """Department name of a session's team; a team id that is no number finds none."""
    side = depts.select(F.col("id").cast("bigint").alias("_team"), F.col("name").alias("team_name"))
    return sessions.join(side, F.expr(f"try_cast(`{team}` as bigint)") == F.col("_team"), "left").drop("_team")


def menu_grant_check(role_menus: DataFrame, tenant_menus: DataFrame) -> DataFrame:
    """Grants outside the tenant's allowed menus, on ``(tenant_id, menu_id)``;
    a tenant without a list is not limited."""
    limited = role_menus.join(tenant_menus.select("tenant_id"), "tenant_id", "left_semi")
    return limited.join(tenant_menus, ["tenant_id", "menu_id"], "left_anti")


def referential_guard(parent: DataFrame, children: dict[str, tuple[DataFrame, str]], key="id") -> DataFrame:
    """``(key, reason)``: which dependent tables still hold rows of a parent.
    One row per dependent table, so ``reason`` stays as short as the list."""
    out = None
    for reason, (child, fk) in children.items():
        hit = parent.select(key).join(child.select(F.col(fk).alias(key)), key, "left_semi").withColumn(
            "reason", F.lit(reason))
        out = hit if out is None else out.unionByName(hit)
    return out


def member_of(pairs: DataFrame, links: DataFrame, tenants: DataFrame) -> DataFrame:
    """The ``(user_id, tenant_id)`` switches that are allowed."""
    live = tenants.filter(F.col("status") == ENABLED).select(F.col("id").alias("tenant_id"))
    return pairs.join(links.select("user_id", "tenant_id"), ["user_id", "tenant_id"], "left_semi").join(
        live, "tenant_id", "left_semi")


def label_of(df: DataFrame, ref: DataFrame, code: str, label: Column, default: str) -> DataFrame:
    """Label from a lookup frame ``(code, label)`` with a default."""
    return df.join(ref, code, "left").withColumn("label", F.coalesce(label, F.lit(default)))
