"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import string
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.session import scratch_path

#: Rows that a Python worker takes at a time: it keeps the memory of its largest batch.
ROWS = 1000
#: Code points of white space that separate words: the blank and U+0009 to U+000D.
BLANKS = "[ \\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply `each` to every Arrow batch, `ROWS` rows at a time; rows stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                yield each(batch.slice(first, ROWS))

    return df.mapInArrow(run, schema)


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """An intermediate written to the shared folder and read back, and its path."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that nothing needs any more.

    They go when the driver's collectors, Python's first, have found their
    owners dead; some owners hold others, hence the turns, and the cleaner works
    in the background, hence the pauses.
    """
    for _ in range(3):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)
