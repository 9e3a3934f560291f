"""Asset search, autocomplete and result orders."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialake.functions.text import any_contains_ci, contains_ci

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def text_match(df: DataFrame, query: str, scalars: list[str], arrays: list[str] = ()) -> DataFrame:
    """Rows where a scalar column or a list element contains the query, ignoring case."""
    if not query:
        return df
    tests = [contains_ci(c, query) for c in scalars] + [any_contains_ci(c, query) for c in arrays]
    return df.filter(reduce(lambda a, b: a | b, tests))


def photo_search(
    photos: DataFrame,
    query: str = "",
    project_id: Any = None,
    tags: list[str] | None = None,
    status: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Text search with optional filters that must all hold; newest first."""
    found = photos
    if project_id is not None:
        found = found.filter(F.col("project_id") == F.lit(project_id))
    if status:
        found = found.filter(F.col("status") == status)
    if start is not None and end is not None:
        moment = photos.schema["created_at"].dataType
        found = found.filter(
            F.col("created_at").between(F.lit(start).cast(moment), F.lit(end).cast(moment))
        )
    if tags:
        found = found.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    found = text_match(found, query, ["title", "description"], ["tags"])
    return found.orderBy(F.desc("created_at"), "photo_id")


def faceted_search(assets: DataFrame, query: str, facets: list[tuple[str, str]] = ()) -> DataFrame:
    """Five fields are searched; every facet must hold; an empty query finds nothing."""
    if not query:
        return assets.limit(0)
    found = text_match(assets, query, ["title", "original", "camera", "location"], ["tags"])
    for kind, value in facets:
        if kind == "tag":
            found = found.filter(any_contains_ci("tags", value))
        elif kind in ("preset", "location", "camera"):
            found = found.filter(contains_ci("preset_name" if kind == "preset" else kind, value))
        elif kind == "date":
            found = found.filter(F.contains(F.date_format("created_at", ISO), F.lit(value)))
    return found


def sort_results(found: DataFrame, by: str = "relevance") -> DataFrame:
    return found.orderBy(*result_order(by))


def autocomplete(assets: DataFrame, query: str, k: int = 5) -> DataFrame:
    """Tags, then cameras, then locations containing the query, each in first-seen order.

    First seen means the smallest (time, id, place in the list); one small struct per value is
    aggregated, so the assets themselves are neither sorted nor shuffled.
    """
    empty = assets.select(F.lit("").alias("value"), F.lit(0).alias("rank")).limit(0)
    if len(query) < 2:
        return empty
    n = F.coalesce(F.size("tags"), F.lit(0))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    offered = assets.select(
        "created_at",
        "photo_id",
        n.alias("n"),
        F.posexplode(F.concat(tags, F.array("camera", "location"))).alias("pos", "value"),
    ).filter(contains_ci("value", query))
    kind = (
        F.when(F.col("pos") < F.col("n"), 1).when(F.col("pos") == F.col("n"), 2).otherwise(3)
    )
    seen = offered.groupBy("value").agg(
        F.min(F.struct(kind.alias("kind"), "created_at", "photo_id", "pos")).alias("first")
    )
    return seen.orderBy("first", "value").limit(k).select("value", F.col("first.kind").alias("rank"))


def project_list(projects: DataFrame, query: str = "", sort: str = "recent") -> DataFrame:
    """Name search and the five orders of the project list."""
    found = projects.filter(contains_ci("name", query)) if query else projects
    return found.orderBy(*project_order(sort))


def placed(df: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows of a total order with their ``place``; only these k are numbered."""
    return df.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def project_order(sort: str = "recent") -> list[Column]:
    """The five orders of the project list, completed by the id."""
    count = F.coalesce("photo_count", F.lit(0))
    orders = {
        "alpha": F.collate("name", "UNICODE"),
        "imgs_desc": count.desc(),
        "imgs_asc": count.asc(),
        "oldest": F.asc("updated_at"),
        "recent": F.desc("updated_at"),
    }
    return [orders.get(sort, orders["recent"]), F.col("project_id")]


def result_order(by: str = "relevance") -> list[Column]:
    """Result orders; relevance keeps the input order, given by the asset id."""
    if by == "time":
        return [F.desc("created_at"), F.col("photo_id")]
    if by in ("camera", "preset"):
        column = "preset_name" if by == "preset" else "camera"
        return [F.collate(F.coalesce(column, F.lit("")), "UNICODE"), F.col("photo_id")]
    return [F.col("photo_id")]


def top(df: DataFrame, k: int, *order) -> DataFrame:
    """First k rows of a total order, kept as a running top-k per task."""
    return df.orderBy(*order).limit(k)
