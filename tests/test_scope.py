"""All 32 subsets of the five scopes against a plain loop."""

from itertools import combinations

import pytest

from tablegov.operators import scope as S
from tablegov.spec import Ctx, Role, TableSpec

DEPTS = [(1, None), (2, 1), (3, 1), (4, 2), (5, 4), (6, None)]
USERS = [(10, 2), (11, 4), (12, 5), (13, 3), (14, 6), (15, None)]
ROWS = [(i, u) for i, (u, _) in enumerate(USERS)] + [(100, 99), (101, None)]
SPEC = TableSpec("t")


@pytest.fixture(scope="module")
def frames(spark):
    return (spark.createDataFrame(ROWS, "id bigint, created_id bigint"),
            spark.createDataFrame(USERS, "id bigint, dept_id bigint"),
            spark.createDataFrame(DEPTS, "id bigint, parent_id bigint"))


def below(dept):
    out, todo = set(), [dept]
    while todo:
        d = todo.pop()
        out.add(d)
        todo += [i for i, p in DEPTS if p == d]
    return out


def expected(scopes, dept, custom, me=13):
    own = {i for i, c in ROWS if c == me}
    if not scopes:
        return own
    if 4 in scopes:
        return {i for i, _ in ROWS}
    depts = set(custom) if 5 in scopes else set()
    if dept is not None:
        depts |= {dept} if 2 in scopes else set()
        depts |= below(dept) if 3 in scopes else set()
    if not depts:
        return own
    members = {u for u, d in USERS if d in depts}
    return {i for i, c in ROWS if c in members}


@pytest.mark.parametrize("dept,custom", [(2, ()), (2, (6,)), (None, (3,))])
def test_every_scope_subset(frames, dept, custom):
    df, users, depts = frames
    for n in range(6):
        for scopes in combinations([1, 2, 3, 4, 5], n):
            roles = tuple(Role(i, s, custom) for i, s in enumerate(scopes))
            ctx = Ctx(user_id=13, dept_id=dept, roles=roles)
            got = {r.id for r in S.scope_rows(df, SPEC, ctx, users, depts).collect()}
            assert got == expected(set(scopes), dept, custom), (scopes, dept, custom)


def test_unrestricted(frames):
    df, users, depts = frames
    for ctx in [Ctx(), Ctx(user_id=1, is_super=True), Ctx(user_id=1, check_data_scope=False)]:
        assert S.scope_rows(df, SPEC, ctx, users, depts).count() == len(ROWS)


def test_tenant_filter(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id int, tenant_id int")
    shared = TableSpec("t", platform_shared=True)
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(S.tenant_filter(df, SPEC, Ctx(tenant_id=2))) == [2]
    assert ids(S.tenant_filter(df, shared, Ctx(tenant_id=2))) == [1, 2]
    assert ids(S.tenant_filter(df, shared, Ctx(tenant_id=2), reading=False)) == [2]
    assert ids(S.tenant_filter(df, SPEC, Ctx(tenant_id=2, is_super=True))) == [1, 2, 3]
    assert ids(S.tenant_filter(df, SPEC, Ctx())) == [1, 2, 3]
    assert ids(S.tenant_filter(df.drop("tenant_id"), SPEC, Ctx(tenant_id=2))) == [1, 2, 3]


def test_scope_dept(frames):
    _, users, depts = frames
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(S.scope_dept(depts, Ctx(user_id=1, dept_id=2), depts)) == [2]
    assert ids(S.scope_dept(depts, Ctx(user_id=1, dept_id=2, roles=(Role(1, 3),)), depts)) == [2, 4, 5]
    assert ids(S.scope_dept(depts, Ctx(user_id=1, dept_id=2, roles=(Role(1, 1),)), depts)) == [2]
    assert ids(S.scope_dept(users, Ctx(user_id=1, dept_id=2, roles=(Role(1, 2),)), depts, "dept_id", False)) == [10]


def test_permissions(spark):
    users = spark.createDataFrame([(1, False), (2, False), (3, True), (4, False)], "id bigint, is_superuser boolean")
    user_roles = spark.createDataFrame([(1, 1), (2, 2), (4, 3)], "user_id bigint, role_id bigint")
    roles = spark.createDataFrame([(1, "0"), (2, "1"), (3, "0")], "id bigint, status string")
    role_menus = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "role_id bigint, menu_id bigint")
    menus = spark.createDataFrame([(1, "a:b", "0"), (2, "a:c", "1")], "id bigint, permission string, status string")
    ask = lambda *p: sorted(r.id for r in S.has_permission(users, list(p), user_roles, roles, role_menus, menus).collect())
    assert ask("a:b") == [1, 3]
    assert ask("a:c") == [3]
    assert ask("*") == ask() == ask("x", "*:*:*") == [1, 2, 3, 4]
