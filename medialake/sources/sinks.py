"""Writers: health history, JSON report rows, bucketed tables for repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.sources import schemas as S


def append_health(checks: DataFrame, path: str) -> None:
    """Append health records under one folder per day, which retention later drops whole."""
    checks.withColumn("check_date", F.to_date("check_time")).write.mode("append").partitionBy(
        "check_date"
    ).parquet(path)


def read_health(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.HEALTH + ", check_date date").parquet(path)


def as_json(df: DataFrame, name: str = "report") -> DataFrame:
    """Each row as one JSON object."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> None:
    """Save a table hashed and sorted by its join keys: later joins and groupings on those keys
    read it without a shuffle. Use the same bucket count for tables joined to each other."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
