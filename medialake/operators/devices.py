"""Device tags and their collisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake import catalogs as C
from medialake.functions.devices import device_tag


def assign_tags(devices: DataFrame, number: str = "number", mask: int = C.TAG_MASK) -> DataFrame:
    """Add the tag of each eight-digit device number; other numbers get none."""
    return devices.withColumn("tag", device_tag(F.col(number), mask))


def tag_collisions(tagged: DataFrame, number: str = "number") -> DataFrame:
    """Tags shared by several numbers: how many, and the lowest and highest of them."""
    return (
        tagged.filter("tag IS NOT NULL")
        .groupBy("tag")
        .agg(
            F.count_distinct(number).alias("devices"),
            F.min(number).alias("first_number"),
            F.max(number).alias("last_number"),
        )
        .filter("devices > 1")
    )
