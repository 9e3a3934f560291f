"""Output names and the export plan."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake import catalogs as C
from medialake.functions.text import render_name
from medialake.plans.ordering import sequenced


def output_names(
    photos: DataFrame,
    projects: DataFrame,
    rule: str | Column,
    start: Column | int = 1,
) -> DataFrame:
    """File name of each photo: the counter runs per project in order of creation.

    ``start`` may be a column of the projects frame. The project's name comes with the counter, so the
    photos are shuffled once. Photos of an unknown project are named as well, with an empty project
    name and a counter from 1.
    """
    first = F.lit(start) if isinstance(start, int) else start
    about = projects.select("project_id", F.col("name").alias("_project"), first.alias("_start"))
    # Only the first tag travels through the shuffle.
    tag = F.get("tags", F.lit(0)) if "tags" in photos.columns else F.lit(None).cast("string")
    original = F.col("original") if "original" in photos.columns else F.lit(None).cast("string")
    numbered = sequenced(
        photos.select(
            "photo_id", "project_id", "created_at", tag.alias("_tag"), original.alias("_original")
        ),
        ["project_id"],
        ["created_at", "photo_id"],
        F.date_trunc("hour", "created_at"),
        lookup=about,
    )
    return numbered.select(
        "photo_id",
        "project_id",
        render_name(
            rule,
            project=F.coalesce("_project", F.lit("")),
            date=F.col("created_at").cast("date").cast("string"),
            counter=F.col("seq") + F.coalesce("_start", F.lit(1)) - 1,
            tag=F.col("_tag"),
            original=F.col("_original"),
        ).alias("output_name"),
    )


def export_plan(photos: DataFrame, profile: Column) -> DataFrame:
    """One row per photo and requested format, with the settings of the named profile."""
    settings = F.create_map(
        *chain.from_iterable(
            (
                F.lit(key),
                F.struct(F.lit(f).alias("format"), F.lit(r).alias("resolution"), F.lit(q).alias("quality")),
            )
            for key, _, f, r, q in C.EXPORT_PROFILES
        )
    )
    ratios = F.create_map(*chain.from_iterable((F.lit(i), F.lit(r)) for i, _, r in C.EXPORT_FORMATS))
    return photos.select(
        "photo_id", profile.alias("profile"), F.explode("export_formats").alias("format_id")
    ).select(
        "photo_id",
        "profile",
        "format_id",
        F.try_element_at(ratios, F.col("format_id")).alias("ratio"),
        F.try_element_at(settings, F.col("profile")).alias("s"),
    ).select("photo_id", "profile", "format_id", "ratio", "s.format", "s.resolution", "s.quality")


def export_totals(plan: DataFrame) -> DataFrame:
    return plan.groupBy("profile", "format_id", "ratio", "format", "resolution", "quality").agg(
        F.count(F.lit(1)).alias("files")
    )
