"""Permission guards: flags over all accounts, and decorators for driver-side functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, functions as F


def account_flags(accounts: DataFrame, account_roles: DataFrame, roles: DataFrame, role_permissions: DataFrame, code: str) -> DataFrame:
    """``(account_id, manager, may_update)``: whether a role is admin or manager, and whether one grants the code."""
    manager = account_roles.join(roles.where(F.col("code").isin("admin", "manager")), "role_id", "left_semi").select("account_id", F.lit(True).alias("manager")).distinct()
    granted = account_roles.join(role_permissions.where(F.col("code") == code), "role_id", "left_semi").select("account_id", F.lit(True).alias("may_update")).distinct()
    return accounts.select("account_id").join(manager, "account_id", "left").join(granted, "account_id", "left").na.fill(False)


class Denied(PermissionError):
    """The caller lacks what a guard asks for."""


def guarded(check: Callable[..., DataFrame]):
    """Runs a function only if check(*args) has a row: one existence query before it."""

    def wrap(fn: Callable):
        @wraps(fn)
        def run(*args, **kwargs):
            if check(*args, **kwargs).isEmpty():
                raise Denied(fn.__name__)
            return fn(*args, **kwargs)

        return run

    return wrap
