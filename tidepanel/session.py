"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE splits skewed join partitions and coalesces small shuffle partitions at
# run time; every operator in the package is written on that assumption.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str, master: str | None = None, **settings: str) -> SparkSession:
    """A session with the recommended settings; `settings` override them."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Folders of applications that name none.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for written intermediates.

    Named by ``spark.checkpoint.dir``. Only a session that names none (a local
    test) gets a folder of its own, the same for the whole application.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


# What this process has written for each application, until `clear_scratch`.
_SCRATCH: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _file_system(spark, path)
    return system.exists(place)


def clear_reports(spark: SparkSession) -> None:
    """Delete the reports in the shared folder, so that the next query that needs one makes it."""
    system, place = _file_system(spark, f"{shared_dir(spark)}/report-*")
    for status in system.globStatus(place) or []:
        system.delete(status.getPath(), True)


def clear_scratch(spark: SparkSession) -> int:
    """Delete every intermediate that this session has written; call it when their results have been used."""
    paths = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        system, place = _file_system(spark, path)
        system.delete(place, True)
    return len(paths)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the shared folder."""
    system, place = _file_system(spark, path)
    system.delete(place, True)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate that several branches read, and read it back.

    The table lives in the shared folder, so losing an executor costs nothing
    and every branch scans columns instead of recomputing the plan above.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
