"""Running a stream over what is there, into a table in the shared folder."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.session import file_system, is_folder, scratch_path
from medialake.sources import schemas as S


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """The events as a stream, from a table folder or a single file. Event time must carry a zone for
    watermarks, hence the cast."""
    reader = spark.readStream.schema(S.TESTDATA["events"]).option(
        "maxFilesPerTrigger", files_per_batch
    )
    path = os.path.join(folder, "events.parquet")
    if is_folder(spark, path):
        stream = reader.parquet(path)
    else:
        stream = reader.option("pathGlobFilter", "events.parquet").parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(stream: DataFrame, name: str, mode: str = "append", root: str | None = None) -> DataFrame:
    """Process everything available, then read the written rows.

    Rows go from the tasks to files and never through the driver; offsets and state lie beside them.
    With a `root` folder of one's own, a later run continues where the one before stopped; without,
    every run has a fresh folder.
    """
    spark = stream.sparkSession
    root = root or scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", os.path.join(root, "checkpoint"))
        .option("path", os.path.join(root, "rows"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(os.path.join(root, "rows"))


def run_parts(
    stream: DataFrame,
    name: str,
    part: Callable[[DataFrame], DataFrame],
    merge: Callable[[DataFrame], DataFrame] | None = None,
    every: int = 0,
    root: str | None = None,
) -> DataFrame:
    """Reduce every batch of a stored stream to a part, then read all parts.

    A part is a folder named by its batch, written whole, so a batch that is run again leaves the
    same part. With ``merge``, each ``every`` parts of one level become one of the next; the smaller
    ones go once the larger one is complete. Which parts count follows from the number of committed
    batches alone, which is read from the checkpoint: with a `root` folder of one's own, a later run
    continues, also if nothing new came in. Without, every run has a fresh folder.
    """
    spark = stream.sparkSession
    root = root or scratch_path(spark, name)
    shape = part(spark.createDataFrame([], stream.schema)).schema

    def path(level: int, number: int) -> str:
        return os.path.join(root, "parts", f"level{level}-{number}")

    def read(paths: list[str]) -> DataFrame:
        return spark.read.schema(shape).parquet(*paths)

    def write(rows: DataFrame, batch: int) -> None:
        part(rows).write.mode("overwrite").parquet(path(0, batch))
        level, number = 0, batch
        while merge and (number + 1) % every == 0:
            old = [path(level, number - k) for k in range(every)]
            level, number = level + 1, number // every
            if all(_written(spark, p) for p in old):  # else an earlier run has merged and removed them
                merge(read(old)).write.mode("overwrite").parquet(path(level, number))
                for p in old:
                    fs, place = file_system(spark, p)
                    fs.delete(place, True)

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", os.path.join(root, "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    left, level, paths = _committed(spark, os.path.join(root, "checkpoint")), 0, []
    while left:  # the digits of the batch count say which parts of each level are not merged
        digit = left % every if merge else left
        paths += [path(level, left - 1 - k) for k in range(digit)]
        left, level = (left // every, level + 1) if merge else (0, level)
    return read(paths) if paths else spark.createDataFrame([], shape)


def _written(spark: SparkSession, path: str) -> bool:
    fs, place = file_system(spark, os.path.join(path, "_SUCCESS"))
    return fs.exists(place)


def _committed(spark: SparkSession, checkpoint: str) -> int:
    """How many batches of a stream are complete."""
    fs, place = file_system(spark, os.path.join(checkpoint, "commits"))
    names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    return 1 + max((int(n) for n in names if n.isdigit()), default=-1)
