"""Tenant visibility: what a user may see or change.

Policies are joins on the membership table. Where several apply to one table a row is visible when
any of them allows it. Administrator rights hold per organization: an administrator of one
organization has no rights in another.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.plans.skew import join_lookup


def _orgs_of(memberships: DataFrame, user_id: Any, role: str | None = None) -> DataFrame:
    mine = memberships.filter(F.col("user_id") == F.lit(user_id))
    if role:
        mine = mine.filter(F.col("role") == role)
    return mine.select("org_id")


def visible_rows(df: DataFrame, memberships: DataFrame, user_id: Any) -> DataFrame:
    """Organizations or projects of the organizations a user belongs to."""
    return df.join(_orgs_of(memberships, user_id), "org_id", "left_semi")


def admin_rows(df: DataFrame, memberships: DataFrame, user_id: Any) -> DataFrame:
    """Organizations or projects a user may change."""
    return df.join(_orgs_of(memberships, user_id, "admin"), "org_id", "left_semi")


def visible_memberships(memberships: DataFrame, user_id: Any) -> DataFrame:
    """One's own memberships, or all of the organizations one administers."""
    mine = F.col("user_id") == F.lit(user_id)
    managed = memberships.filter(~F.coalesce(mine, F.lit(False))).join(
        _orgs_of(memberships, user_id, "admin"), "org_id", "left_semi"
    )
    return memberships.filter(mine).unionByName(managed)


def own_profile(users: DataFrame, user_id: Any) -> DataFrame:
    return users.filter(F.col("user_id") == F.lit(user_id))


def with_organization(projects: DataFrame, organizations: DataFrame) -> DataFrame:
    """Projects with their organization's columns, null when there is none."""
    return projects.join(organizations, "org_id", "left")


def with_role(rows: DataFrame, memberships: DataFrame) -> DataFrame:
    """Role of each row's user in the row's organization; null without membership. A user has at
    most one membership per organization."""
    return rows.join(memberships.select("user_id", "org_id", "role"), ["user_id", "org_id"], "left")


def tenant_matrix(memberships: DataFrame, projects: DataFrame) -> DataFrame:
    """For every user: organizations, visible projects and projects they may change.

    Projects are counted per organization first, so memberships meet one row per organization and
    no pair of user and project is ever produced.
    """
    per_org = projects.groupBy("org_id").agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(F.col("status") == "active").alias("_active")
    )
    n = F.coalesce("_all", F.lit(0))
    return (
        join_lookup(memberships.select("user_id", "org_id", "role"), per_org, ["org_id"])
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("organizations"),
            F.sum(n).alias("visible_projects"),
            F.sum(F.coalesce("_active", F.lit(0))).alias("visible_active"),
            F.sum(F.when(F.col("role") == "admin", n).otherwise(F.lit(0))).alias("admin_projects"),
        )
    )


def photos_of_user(photos: DataFrame, projects: DataFrame, user_id: Any) -> DataFrame:
    """Photos in a user's projects."""
    mine = projects.filter(F.col("user_id") == F.lit(user_id)).select("project_id")
    return photos.join(mine, "project_id", "left_semi")
