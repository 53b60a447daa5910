"""Governed, multi-tenant tables and event logs on Spark DataFrames."""

from tablegov.session import get_spark
from tablegov.spec import Ctx, Role, TableSpec

__all__ = ["Ctx", "Role", "TableSpec", "get_spark"]
