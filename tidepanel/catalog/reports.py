"""Reports: written once and read by the queries that follow them.

A fold job and the decision over its folds are separate jobs with a written
report between them, so the queries share the report the same way. A report's
path names what it was made from: the files of the tables with their lengths and
times, and the code of this package. Other data, code or another shared folder
mean another report, and nothing is held in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import tidepanel
from tidepanel.catalog.tables import Tables
from tidepanel.session import exists, shared_dir

SOURCES = ("lineitem", "part", "events")


@cache
def code_digest() -> str:
    """SHA-256 over the modules that reports are made with."""
    root = Path(tidepanel.__file__).parent
    whole = hashlib.sha256()
    for folder in ("catalog", "functions", "operators", "plans"):
        for path in sorted((root / folder).glob("*.py")):
            whole.update(path.read_bytes())
    return whole.hexdigest()


def data_digest(t: Tables) -> str:
    """SHA-256 over the names, lengths and times of the files that reports read; no content is read."""
    files = None
    for name in SOURCES:
        listed = t.spark.read.format("binaryFile").load(f"{t.sf_dir}/{name}.parquet").select("path", "length", "modificationTime")
        files = listed if files is None else files.union(listed)
    line = F.concat_ws("|", "path", "length", F.unix_micros("modificationTime"))
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("d")).first().d


def report(t: Tables, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The named report over `t`, written if it is not there yet."""
    key = hashlib.sha256(f"{data_digest(t)}|{code_digest()}".encode()).hexdigest()[:24]
    path = f"{shared_dir(t.spark)}/report-{name}-{key}"
    if not exists(t.spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return t.spark.read.parquet(path)


def reports(t: Tables, names: Sequence[str], build: Callable[[], Sequence[DataFrame]]) -> list[DataFrame]:
    """The named reports of one job, which runs once if any of them is not there yet."""
    made: list[DataFrame] = []

    def part(i: int) -> DataFrame:
        if not made:
            made.extend(build())
        return made[i]

    return [report(t, name, lambda i=i: part(i)) for i, name in enumerate(names)]
