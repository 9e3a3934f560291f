"""Details of checks and audit entries: free JSON, parsed once when written and typed when read.

A details column comes as text of any shape. Writers keep it as a variant, so a reader that asks for one
path doesn't parse the rest again. Text that is no JSON has no value; it is kept beside it as it came.
A path that isn't there, or whose value isn't of the asked type, is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.sources import schemas as S


def parsed(df: DataFrame, column: str = "details") -> DataFrame:
    """`column` as a variant, `<column>_raw` with what couldn't be parsed, and `malformed`."""
    value = F.try_parse_json(column)
    broken = F.col(column).isNotNull() & value.isNull()
    return df.withColumns(
        {f"{column}_raw": F.when(broken, F.col(column)), "malformed": broken, column: value}
    )


def typed(df: DataFrame, paths: dict[str, tuple[str, str]], column: str = "details") -> DataFrame:
    """One column for each name: the value at its path as its type."""
    return df.withColumns({name: F.try_variant_get(column, path, kind) for name, (path, kind) in paths.items()})


def append_checks(checks: DataFrame, path: str) -> None:
    """Append health records with parsed details under one folder per day."""
    parsed(checks).withColumn("check_date", F.to_date("check_time")).write.mode("append").partitionBy(
        "check_date"
    ).parquet(path)


def read_checks(spark: SparkSession, path: str, more: str = "") -> DataFrame:
    """Stored health records; `more` names further columns that were written."""
    health = S.HEALTH.replace("details string", "details variant")
    schema = ", ".join(x for x in (health, more, "details_raw string, malformed boolean, check_date date") if x)
    return spark.read.schema(schema).parquet(path)


def audit_details(entries: DataFrame, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """Audit entries whose `details` are JSON, with typed columns of it."""
    return typed(parsed(entries), paths)
