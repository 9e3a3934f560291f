"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid

from pyspark.sql import SparkSession

# Runtime settings every job relies on. The time zone is part of the results (hours of day, day
# buckets); the others let the engine split a hot key after a shuffle or merge it before one.
_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime settings on a session that may have been made elsewhere. They stay set: results
    depend on the time zone also when a frame that was built here is used later."""
    for key, value in _RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int = 8, app: str = "medialake", scratch: str = "/tmp/medialake-scratch") -> SparkSession:
    """A single-JVM session for tests and the benchmark; clusters bring their own. What jobs hand
    over goes below ``scratch``; ``drop_scratch`` removes this application's part of it."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", scratch)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def scratch_root(spark: SparkSession) -> str:
    """Folder for checkpoints and hand-over tables: the one the cluster names, shared by all
    executors. Only a local session may name none: its warehouse then gets a folder for it, which goes
    when the process ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        root = os.path.join(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:"), "medialake-scratch")
        spark.sparkContext.setCheckpointDir(root)
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for this application under the shared folder; the random part only keeps runs
    apart."""
    return os.path.join(_own_folder(spark), f"{name}-{uuid.uuid4().hex}")


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder. Frames read from it are then gone."""
    fs, path = file_system(spark, _own_folder(spark))
    fs.delete(path, True)


def file_system(spark: SparkSession, path: str):
    """The file system of a path, local or shared, and the path in its terms."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def _own_folder(spark: SparkSession) -> str:
    return os.path.join(scratch_root(spark), "medialake", spark.sparkContext.applicationId)
