"""Per-project gallery documents: JSON text ``{project: [items]}`` to rows and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.session import scratch_path
from medialake.sources import schemas as S

ITEM_FIELDS = list(S.GALLERY_FIELDS)


def read_gallery_documents(docs: DataFrame, text: str = "value") -> DataFrame:
    """One row per item. Documents are independent, so a project may be spread over several."""
    parsed = docs.select(F.from_json(text, S.GALLERY_DOCUMENT).alias("doc"))
    entries = parsed.select(F.explode("doc").alias("project_id", "items"))
    return entries.select("project_id", F.inline("items"))


def to_gallery_documents(items: DataFrame, chunk: int = 1000, large: DataFrame | None = None) -> DataFrame:
    """JSON documents of one project each, with about half of ``chunk`` items, hardly ever more than it.

    A project of any size is written whole, but as several documents: its items are dealt by a hash
    of their id to as many documents as its size asks for. Items are in order of their id within a
    document. ``large`` may give what ``large_projects`` finds, where it is known already.
    """
    sizes = large_projects(items, chunk) if large is None else large
    parts = F.ceil(2 * F.coalesce("_size", F.lit(1)) / F.lit(chunk))
    pieces = items.join(sizes, "project_id", "left").withColumn("_doc", F.pmod(F.xxhash64("id"), parts))
    packed = pieces.groupBy("project_id", "_doc").agg(
        F.sort_array(F.collect_list(F.struct(*ITEM_FIELDS))).alias("run")  # the id is their first field
    )
    return packed.select(
        F.to_json(F.map_from_entries(F.array(F.struct(F.col("project_id").cast("string"), F.col("run")))))
        .alias("value")
    )


def large_projects(items: DataFrame, chunk: int) -> DataFrame:
    """Sizes of the projects that need more than one document."""
    sizes = items.groupBy("project_id").agg(F.count(F.lit(1)).alias("_size"))
    return sizes.filter(2 * F.col("_size") > chunk)


def save_gallery(items: DataFrame, path: str, chunk: int = 1000, keys: DataFrame | None = None) -> None:
    """Write the documents. The few large projects are found and written first, so their size is known
    and the join to them has shuffles of its own, or none. ``keys`` may be a cheaper frame with at
    least one row per item, to count them by."""
    place = scratch_path(items.sparkSession, "gallery-sizes")
    found = large_projects(items if keys is None else keys, chunk)
    found.write.parquet(place)
    large = items.sparkSession.read.schema(found.schema).parquet(place)
    # A compressed file is read by one task, so its number of documents is bounded.
    out = to_gallery_documents(items, chunk, large).write.mode("overwrite").option("compression", "gzip")
    out.option("maxRecordsPerFile", max(1, 1_000_000 // chunk)).text(path)


def load_gallery(spark: SparkSession, path: str) -> DataFrame:
    return read_gallery_documents(spark.read.text(path))
