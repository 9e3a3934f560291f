"""A history that a stream appends to and that forgets old days while the stream runs.

Every batch is a folder of day folders, written whole, so a batch that runs again leaves the same rows.
When its rows are there, its manifest is: the first day that is still kept, which never goes back. Rows
of earlier days are not written, whatever batch brings them and however late or often, and day folders
before it are dropped. Readers take the manifests' latest day as well, so an interrupted run shows no
day that was given up. Manifests are one small file a batch; their number is that of the batches.
"""

from __future__ import annotations

import os
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.session import file_system

DAY = "check_date"


class KeptHistory:
    """The rows of a stream by day under `root`, for `days` days up to the latest one seen."""

    def __init__(self, spark: SparkSession, root: str, schema: str, time: str, days: int):
        self.spark, self.root, self.schema, self.time, self.days = spark, root, schema, time, days

    def first_day(self) -> str:
        """The first day that is kept: the latest of all manifests'."""
        fs, place = file_system(self.spark, f"{self.root}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
        return max((n.partition("_")[2] for n in names if "_" in n and not n.startswith((".", "_"))), default="0001-01-01")

    def add(self, rows: DataFrame, batch: int) -> None:
        """Write one batch, then its manifest, then drop the days given up. Rows without a time go."""
        timed = rows.withColumn(DAY, F.to_date(self.time))
        latest = timed.agg(F.max(DAY)).first()[0]
        first = self.first_day()
        if latest is not None:
            first = max(first, (latest - timedelta(days=self.days)).isoformat())
        kept = timed.filter(F.col(DAY) >= F.lit(first).cast("date"))
        kept.write.mode("overwrite").partitionBy(DAY).parquet(f"{self.root}/rows/batch={batch}")
        fs, place = file_system(self.spark, f"{self.root}/manifests/{batch:012d}_{first}")
        fs.create(place, True).close()
        self.drop_before(first)

    def drop_before(self, first: str) -> list[str]:
        """Drop the day folders before a day; only folder names are listed."""
        fs, top = file_system(self.spark, f"{self.root}/rows")
        dropped = []
        for batch in fs.listStatus(top):
            for day in fs.listStatus(batch.getPath()):
                name = day.getPath().getName()
                if name.startswith(f"{DAY}=") and date.fromisoformat(name.split("=")[1]) < date.fromisoformat(first):
                    fs.delete(day.getPath(), True)
                    dropped.append(f"{batch.getPath().getName()}/{name}")
        return sorted(dropped)

    def read(self) -> DataFrame:
        fs, top = file_system(self.spark, f"{self.root}/rows")
        if not fs.exists(top):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, batch long, {DAY} date").parquet(f"{self.root}/rows")
        return rows.filter(F.col(DAY) >= F.lit(self.first_day()).cast("date")).drop("batch", DAY)

    def run(self, stream: DataFrame, checkpoint: str) -> DataFrame:
        """Add everything that a stream has, then read the history."""
        query = (
            stream.writeStream.foreachBatch(self.add)
            .option("checkpointLocation", os.path.join(self.root, checkpoint))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return self.read()
