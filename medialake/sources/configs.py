"""Configuration and key-metadata scans.

A file is parsed inside its own row: cut into section blocks, blocks into lines, lines into fields,
with two explodes and no shuffle. Only resolving repeated keys groups, by file and key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The grammar of the files.
SECTION = r"^\[([a-zA-Z_][a-zA-Z0-9_]*)\]"
SETTING = r"^\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*(.*)$"
ENV_LINE = r"^([A-Za-z_][A-Za-z0-9_]*)=(.*)$"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as ``(source, text)``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source"), F.col("value").alias("text")
    )


def write_bundles(texts: DataFrame, path: str) -> None:
    """Store whole files, one a row of ``(source, text)``, many in one file of the folder. A folder of
    very many small files costs a create, a listing and an open each, which outweighs their parsing."""
    texts.select("source", "text").hint("rebalance").write.parquet(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as ``(source, text)``, as they went into ``write_bundles``; the source is a number."""
    return spark.read.schema("source long, text string").parquet(path)


def parse_config(texts: DataFrame) -> DataFrame:
    """``(source, key, value)`` rows of INI texts; keys carry their section as a prefix.

    Comments and blanks are skipped, one pair of quotes of each kind is cut from a value, and the
    last of repeated keys wins.
    """
    blocks = texts.select(
        "source", F.posexplode(F.split("text", r"(?m)(?=" + SECTION + ")")).alias("block_no", "block")
    )
    lines = blocks.select(
        "source",
        "block_no",
        F.regexp_extract("block", SECTION, 1).alias("section"),
        F.posexplode(F.split("block", r"\r?\n")).alias("line_no", "line"),
    ).filter(~F.col("line").rlike(r"^\s*#") & F.col("line").rlike(SETTING))
    value = F.regexp_extract("line", SETTING, 2)
    for pattern in ('"$', '^"', "'$", "^'"):
        value = F.regexp_replace(value, pattern, "")
    name = F.regexp_extract("line", SETTING, 1)
    rows = lines.select(
        "source",
        F.when(F.col("section") == "", name).otherwise(F.concat("section", F.lit("_"), name)).alias("key"),
        value.alias("value"),
        F.struct("block_no", "line_no").alias("at"),
    )
    return rows.groupBy("source", "key").agg(F.max_by("value", "at").alias("value"))


def env_lines(texts: DataFrame) -> DataFrame:
    """Every ``NAME=value`` line at column one of environment files: ``(source, key, value, line_no)``."""
    lines = texts.select("source", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    return lines.filter(F.col("line").rlike(ENV_LINE)).select(
        "source",
        F.regexp_extract("line", ENV_LINE, 1).alias("key"),
        F.regexp_extract("line", ENV_LINE, 2).alias("value"),
        "line_no",
    )


def parse_env(texts: DataFrame) -> DataFrame:
    """``(source, key, value)`` rows of environment files; the last of repeated keys wins."""
    return env_lines(texts).groupBy("source", "key").agg(F.max_by("value", "line_no").alias("value"))


def parse_key_metadata(texts: DataFrame) -> DataFrame:
    """Key files of ``name: value`` lines as typed columns."""
    fields = F.map_from_entries(
        F.transform(
            F.filter(F.split("text", r"\r?\n"), lambda l: F.contains(l, F.lit(": "))),
            lambda l: F.struct(
                F.trim(F.substring_index(l, ": ", 1)),
                F.trim(F.regexp_replace(l, r"^[^:]*: ", "")),
            ),
        )
    )
    parsed = texts.select("source", fields.alias("f"))

    def get(name: str):
        return F.try_element_at("f", F.lit(name))

    return parsed.select(
        "source",
        get("type").alias("key_type"),
        F.try_to_timestamp(get("created")).alias("created_at"),
        get("creator").alias("creator"),
        get("checksum").alias("checksum"),
    )
