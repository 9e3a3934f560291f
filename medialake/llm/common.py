"""Small helpers that several corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.session import scratch_path

# The six ASCII white-space characters that separate words, and the ASCII letters.
SPACES = "\t\n\x0b\x0c\r "
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

# Folds A-Z in UTF-8 bytes; bytes of other characters are never in this range.
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers on this machine find the package also where it is not installed and the
    driver found it by its own path. Clusters install it or ship it with the job."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write a frame to the shared folder and read it back: what follows no longer depends on the
    executors that made it."""
    spark = df.sparkSession
    reach_workers(spark)
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
    """Like `saved`, in files by a hash of a key: a join by it to a side dealt into as many partitions
    has no shuffle of this side."""
    spark = df.sparkSession
    reach_workers(spark)
    path = scratch_path(spark, name)
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(table)
    return spark.table(table)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of a text as UTF-8; bytes.split() cuts at exactly the ASCII spaces."""
    return (text or "").encode().translate(FOLD).split()


def byte_ranges(texts: pa.Array, start: int, stop: int, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows from `start` to `stop` with about `size` bytes of text each."""
    n = pc.fill_null(pc.binary_length(texts.slice(start, stop - start)), 0)
    part = np.cumsum(n.to_numpy(zero_copy_only=False), dtype=np.int64) // size
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), stop - start]
    for a, b in zip(edges, edges[1:], strict=False):
        yield start + a, start + b


def text_blocks(batches: Iterator[pa.RecordBatch], column: int, size: int, rows: int = 1 << 30) -> Iterator[pa.Table]:
    """A task's rows in blocks of about `size` bytes of text and at most `rows` rows; one row is
    never cut."""
    held, n_held, n_rows = [], 0, 0
    for batch in batches:
        for a, b in byte_ranges(batch.column(column), 0, batch.num_rows, max(size // 8, 1)):
            while a < b:
                part = batch.slice(a, min(b - a, rows - n_rows))
                held.append(part)
                n_held += pc.sum(pc.binary_length(part.column(column))).as_py() or 0
                n_rows += part.num_rows
                a += part.num_rows
                if n_held >= size or n_rows >= rows:
                    yield pa.Table.from_batches(held)
                    held, n_held, n_rows = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)
