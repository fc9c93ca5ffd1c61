"""Roles, groups and permissions, closed over inheritance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entigraph.operators.hierarchy import closure


def role_permissions(roles: DataFrame) -> DataFrame:
    """(role, permission), own and inherited, from roles (id, permissions, inherits_from)."""
    up = closure(roles.select(F.col("id").alias("src"), F.explode("inherits_from").alias("dst"))).select(F.col("src").alias("role"), F.col("dst").alias("from"))
    every = up.union(roles.select(F.col("id").alias("role"), F.col("id").alias("from")))
    own = roles.select(F.col("id").alias("from"), F.explode("permissions").alias("permission"))
    return every.join(own, "from").select("role", "permission").distinct()


def principal_roles(principals: DataFrame, groups: DataFrame) -> DataFrame:
    """(principal, role): own roles and those of the groups; principals (id, roles, groups), groups (id, roles)."""
    own = principals.select(F.col("id").alias("principal"), F.explode("roles").alias("role"))
    member = principals.select(F.col("id").alias("principal"), F.explode("groups").alias("group"))
    given = groups.select(F.col("id").alias("group"), F.explode("roles").alias("role"))
    return own.union(member.join(given, "group").select("principal", "role")).distinct()


def principal_permissions(principals: DataFrame, groups: DataFrame, roles: DataFrame) -> DataFrame:
    return principal_roles(principals, groups).join(role_permissions(roles), "role").select("principal", "permission").distinct()


def has_permission(requests: DataFrame, granted: DataFrame) -> DataFrame:
    """requests (principal, permission, ...) that are granted."""
    return requests.join(granted, ["principal", "permission"], "left_semi")


def has_role(requests: DataFrame, held: DataFrame) -> DataFrame:
    return requests.join(held, ["principal", "role"], "left_semi")
