"""Table description and caller context."""

from __future__ import annotations

from dataclasses import dataclass, field

# Data scopes of a role.
SCOPE_SELF = 1
SCOPE_DEPT = 2
SCOPE_DEPT_AND_CHILDREN = 3
SCOPE_ALL = 4
SCOPE_CUSTOM = 5

# Id of the platform tenant, enabled and disabled status.
PLATFORM_TENANT = 1
ENABLED = "0"
DISABLED = "1"


@dataclass(frozen=True)
class TableSpec:
    """Which columns of a table carry governance meaning.  A column that is
    ``None`` does not exist in the table, and the rules based on it are off."""

    name: str
    key: str = "id"
    tenant: str | None = "tenant_id"
    creator: str | None = "created_id"
    updater: str | None = "updated_id"
    created_time: str | None = "created_time"
    updated_time: str | None = "updated_time"
    deleted: str | None = "is_deleted"
    deleted_time: str | None = "deleted_time"
    deleted_id: str | None = "deleted_id"
    status: str | None = "status"
    dept: str | None = None
    platform_shared: bool = False
    defaults: dict = field(default_factory=dict)

    @property
    def soft_deletes(self) -> bool:
        """Soft delete needs all three columns."""
        return bool(self.deleted and self.deleted_time and self.deleted_id)


@dataclass(frozen=True)
class Role:
    id: int
    data_scope: int
    dept_ids: tuple = ()


@dataclass(frozen=True)
class Ctx:
    """Who asks."""

    user_id: int | None = None
    tenant_id: int | None = None
    dept_id: int | None = None
    is_super: bool = False
    roles: tuple[Role, ...] = ()
    check_data_scope: bool = True

    @property
    def scopes(self) -> set[int]:
        return {r.data_scope for r in self.roles}

    @property
    def custom_depts(self) -> set:
        return {d for r in self.roles if r.data_scope == SCOPE_CUSTOM for d in r.dept_ids}
