"""Table scans: the driver's tables, tenant tables from files or a database, nested photo files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.sources import schemas as S


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(S.TESTDATA[name]).parquet(f"{folder}/{name}.parquet")


def tenant_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tenant table from parquet; a missing activity flag counts as active."""
    df = spark.read.schema(schema).parquet(path)
    if "is_active" in df.columns:
        df = df.withColumn("is_active", F.coalesce("is_active", F.lit(True)))
    return df


def tenant_table_jdbc(
    spark: SparkSession,
    url: str,
    name: str,
    partition_column: str,
    lower: str,
    upper: str,
    partitions: int,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """Tenant table from a live database, read in parallel ranges of one column. Filters and the
    column list are pushed into the database's query."""
    return spark.read.jdbc(
        url,
        name,
        column=partition_column,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        properties=properties or {},
    )


def photo_files(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Photo entities with nested camera metadata."""
    return spark.read.schema(S.PHOTOS).format(fmt).load(path)


def flatten_photos(photos: DataFrame) -> DataFrame:
    """Photo entities as flat rows; unread nested fields are pruned from the scan."""
    return photos.select(
        F.col("id").alias("photo_id"),
        F.col("projectId").alias("project_id"),
        "title",
        "description",
        "tags",
        "status",
        F.col("presetApplied").alias("preset_id"),
        F.col("exportFormats").alias("export_formats"),
        F.to_timestamp("createdAt").alias("created_at"),
        F.to_timestamp("updatedAt").alias("updated_at"),
        F.col("uploadProgress").alias("upload_progress"),
        F.col("uploadStatus").alias("upload_status"),
        F.col("metadata.camera").alias("camera"),
        F.col("metadata.lens").alias("lens"),
        F.col("metadata.settings.iso").alias("iso"),
        F.col("metadata.settings.shutterSpeed").alias("shutter_text"),
        F.col("metadata.settings.aperture").alias("aperture_text"),
        F.col("metadata.location.name").alias("location"),
        F.to_timestamp("metadata.timestamp").alias("taken_at"),
    )


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename columns to a client's spelling."""
    return df.withColumnsRenamed(names)
