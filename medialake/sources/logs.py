"""Log scans: pipe-delimited audit lines and levelled service lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.sources import schemas as S


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """``ts|op|key|user|client`` lines; shorter old lines get nulls at the end."""
    raw = (
        spark.read.schema(S.AUDIT)
        .option("sep", "|")
        .option("mode", "PERMISSIVE")
        .option("quote", "")
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )
    return typed_audit(raw)


def stream_audit(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    raw = (
        spark.readStream.schema(S.AUDIT)
        .option("sep", "|")
        .option("mode", "PERMISSIVE")
        .option("quote", "")
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(path)
    )
    return typed_audit(raw)


def typed_audit(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.try_to_timestamp("ts").alias("ts"),
        "op",
        "key",
        "user",
        "client",
    )


def read_ca_audit(spark: SparkSession, path: str) -> DataFrame:
    """The four-field variant ``ts | user | op | detail`` with blanks around the bars."""
    parts = F.transform(F.split("value", r"\|", 4), lambda p: F.trim(p))
    return spark.read.text(path).select(
        F.try_to_timestamp(F.get(parts, F.lit(0))).alias("ts"),
        F.get(parts, F.lit(1)).alias("user"),
        F.get(parts, F.lit(2)).alias("op"),
        F.get(parts, F.lit(3)).alias("key"),
    )


def parse_service_line(line: Column) -> dict[str, Column]:
    """Split ``[time] text`` or ``[LEVEL] text`` after terminal colour codes are removed."""
    plain = F.regexp_replace(line, "\x1b\\[[0-9;]*m", "")
    head = F.regexp_extract(plain, r"^\[([^\]]*)\] ?(.*)$", 1)
    level = F.when(head.isin("ERROR", "WARN", "INFO"), head)
    stamp = F.when(
        head.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"),
        F.try_to_timestamp(head, F.lit("yyyy-MM-dd HH:mm:ss")),
    )
    framed = level.isNotNull() | stamp.isNotNull()
    message = F.when(framed, F.regexp_extract(plain, r"^\[([^\]]*)\] ?(.*)$", 2)).otherwise(plain)
    return {"level": F.coalesce(level, F.when(stamp.isNotNull(), F.lit("LOG"))), "ts": stamp, "message": message}


def read_service_log(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    return lines.select(*[c.alias(n) for n, c in parse_service_line(F.col("value")).items()])
