"""Registered queries: tenancy and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialake.operators import presets as P
from medialake.operators import tenancy
from medialake.plans.registry import query

VISIBLE = """
    SELECT {columns} FROM {table} t
    WHERE EXISTS (SELECT 1 FROM memberships m WHERE m.org_id = t.org_id AND m.user_id = {user}{role})
    """


@query(
    "visible_projects",
    VISIBLE.format(columns="project_id, org_id, status", table="tenant_projects", user=11, role=""),
    "memberships tenant_projects",
)
def visible_projects(lake):
    seen = tenancy.visible_rows(lake.tenant_projects(), lake.memberships(), 11)
    return seen.select("project_id", "org_id", "status")


@query(
    "visible_organizations",
    VISIBLE.format(columns="org_id, slug", table="organizations", user=11, role=""),
    "memberships organizations",
)
def visible_organizations(lake):
    return tenancy.visible_rows(lake.organizations(), lake.memberships(), 11).select("org_id", "slug")


@query(
    "admin_projects",
    VISIBLE.format(
        columns="project_id, org_id, status", table="tenant_projects", user=20, role=" AND m.role = 'admin'"
    ),
    "memberships tenant_projects",
)
def admin_projects(lake):
    mine = tenancy.admin_rows(lake.tenant_projects(), lake.memberships(), 20)
    return mine.select("project_id", "org_id", "status")


@query(
    "membership_visibility",
    """
    SELECT user_id, org_id, role FROM memberships o
    WHERE user_id = 20
       OR EXISTS (SELECT 1 FROM memberships i
                  WHERE i.org_id = o.org_id AND i.user_id = 20 AND i.role = 'admin')
    """,
    "memberships",
)
def membership_visibility(lake):
    return tenancy.visible_memberships(lake.memberships(), 20).select("user_id", "org_id", "role")


@query("own_profile", "SELECT user_id, name, plan FROM users WHERE user_id = 20", "users")
def own_profile(lake):
    return tenancy.own_profile(lake.users(), 20).select("user_id", "name", "plan")


@query(
    "user_photos",
    """
    SELECT photo_id, project_id FROM photos
    WHERE project_id IN (SELECT project_id FROM projects WHERE user_id = 31)
    """,
    "photos projects",
)
def user_photos(lake):
    return tenancy.photos_of_user(lake.photos(), lake.projects(), 31).select("photo_id", "project_id")


@query(
    "project_with_org",
    """
    SELECT project_id, org_id, org_name, slug
    FROM tenant_projects LEFT JOIN organizations USING (org_id)
    """,
    "tenant_projects organizations",
)
def project_with_org(lake):
    joined = tenancy.with_organization(lake.tenant_projects(), lake.organizations())
    return joined.select("project_id", "org_id", "org_name", "slug")


@query(
    "role_lookup",
    """
    SELECT p.project_id, p.user_id, p.org_id, m.role
    FROM (SELECT project_id, user_id, (org_id + project_id % 3) % 25 AS org_id FROM tenant_projects) p
    LEFT JOIN memberships m ON m.user_id = p.user_id AND m.org_id = p.org_id
    """,
    "tenant_projects memberships",
)
def role_lookup(lake):
    shifted = lake.tenant_projects().select(
        "project_id",
        "user_id",
        ((F.col("org_id") + F.col("project_id") % 3) % 25).alias("org_id"),
    )
    return tenancy.with_role(shifted, lake.memberships()).select("project_id", "user_id", "org_id", "role")


@query(
    "tenant_matrix",
    """
    WITH per_org AS (
        SELECT org_id, count(*) AS n, count(*) FILTER (status = 'active') AS a FROM tenant_projects GROUP BY 1)
    SELECT user_id, count(*) AS organizations, CAST(sum(coalesce(n, 0)) AS BIGINT) AS visible_projects,
           CAST(sum(coalesce(a, 0)) AS BIGINT) AS visible_active,
           CAST(sum(CASE WHEN role = 'admin' THEN coalesce(n, 0) ELSE 0 END) AS BIGINT) AS admin_projects
    FROM memberships LEFT JOIN per_org USING (org_id) GROUP BY 1
    """,
    "tenant_projects memberships",
)
def tenant_matrix(lake):
    return tenancy.tenant_matrix(lake.memberships(), lake.tenant_projects())


@query(
    "project_default_preset",
    """
    SELECT project_id, p.preset_id, p.name AS preset_name
    FROM projects LEFT JOIN presets p ON p.preset_id = default_preset_id
    """,
    "projects presets",
)
def project_default_preset(lake):
    projects = lake.projects()
    defaults = projects.select("project_id", F.col("default_preset_id").alias("preset_id"))
    return P.default_presets(projects, defaults, lake.presets())
