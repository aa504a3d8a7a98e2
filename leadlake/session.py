"""Session helpers: a session with the settings the operators assume, and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def build_session(app_name: str = "leadlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and AQE on. Cluster settings passed by spark-submit still win."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of the shared folder in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster the executors would not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="leadlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later uses do not compute it again, and a
    lost executor costs no more than a file read."""
    folder = work_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    _STORED.append(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows dealt by keys over as many tasks as any shuffle has: few bytes that become much work, so their size must not decide."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Folders of stored steps that have not been released.
_STORED: list[str] = []


def stored_folders() -> set[str]:
    """The folders of the steps stored so far."""
    return set(_STORED)


def release_stored(folders: set[str], docs: DataFrame) -> set[str]:
    """Remove those of ``folders`` that ``docs``, a table of files, does not read; returns the others. For chains of steps whose
    results are written: what was computed from a removed step, and is not written, can no longer be read."""
    files = docs.inputFiles()
    if not files:  # not a table of files: nothing is known about what it reads
        return folders
    spark, left = docs.sparkSession, set()
    for folder in folders:
        name = folder.rstrip("/").rsplit("/", 1)[1]
        if any(f"/{name}/" in f for f in files):
            left.add(folder)
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _STORED.remove(folder)
    return left


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists in the file system of its path."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def local_cpus() -> int:
    return int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
