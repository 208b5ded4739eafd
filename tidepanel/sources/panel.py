"""Point-in-time scans and immutable sinks of panel datasets."""

from __future__ import annotations

import hashlib
import io
import itertools
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as filesystem
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.operators.quality import integrity_reasons, union_by_precedence
from tidepanel.operators.universe import attach_contract_id
from tidepanel.session import staged

BAR_SCHEMA = (
    "instrument_id string, open_time_ns bigint, close_time_ns bigint, available_time_ns bigint, interval_ns bigint, "
    "open double, high double, low double, close double, base_volume double, quote_volume double, "
    "trade_count bigint, source_payload_hash string, venue string"
)
FUNDING_SCHEMA = (
    "instrument_id string, calc_time_ns bigint, funding_interval_hours bigint, rate decimal(18,8), venue string"
)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one of its schema when the path does not exist."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def load_bars(spark: SparkSession, path: str, *, available_before_ns: int | None = None) -> DataFrame:
    """Bars known before a boundary, with their contract id.

    The boundary is a bare comparison on the stored column and reaches the
    Parquet scan; identity is taken over the whole dataset, reading two columns.
    """
    bars = spark.read.schema(BAR_SCHEMA).parquet(path)
    first = bars.groupBy("instrument_id").agg(F.min("open_time_ns").alias("_first"))
    known = bars if available_before_ns is None else bars.filter(F.col("available_time_ns") < available_before_ns)
    return known.join(first, "instrument_id").withColumn(
        "contract_id", F.concat_ws(":", "instrument_id", F.col("_first").cast("string"))
    ).drop("_first")


def load_funding(spark: SparkSession, path: str, bars_path: str) -> DataFrame:
    """Funding events of known instruments; a missing dataset is an empty one."""
    ids = attach_contract_id(
        spark.read.schema(BAR_SCHEMA).parquet(bars_path).select("instrument_id", "open_time_ns")
    ).select("instrument_id", "contract_id").distinct()
    return read_or_empty(spark, path, FUNDING_SCHEMA).join(ids, "instrument_id").select(
        "contract_id", "calc_time_ns", "rate"
    )


def load_leg_bars(spark: SparkSession, perp: str, spot: str, *, available_before_ns: int | None = None) -> DataFrame:
    """Two markets to one boundary, under leg-prefixed contract ids."""
    def market(path: str, name: str) -> DataFrame:
        bars = load_bars(spark, path, available_before_ns=available_before_ns)
        return bars.withColumn("contract_id", F.concat(F.lit(f"{name}:"), F.col("contract_id")))

    return market(perp, "perp").unionByName(market(spot, "spot"))


def publish_bars(bars: DataFrame, path: str, *, partitions: Sequence[str] = ("venue",)) -> None:
    """Write an immutable zstd dataset; an existing one is refused, not replaced.

    Rows are shuffled by partition and instrument first, so each file holds whole
    instruments and a hot partition still spreads over tasks.
    """
    spread = bars.repartition(*partitions, "instrument_id")
    spread.write.mode("errorifexists").option("compression", "zstd").partitionBy(*partitions).parquet(path)


def news(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming records that the log does not hold as they are; `_fresh` tells new keys from known ones with other content."""
    names = [c for c in sorted(existing.columns) if c != key]
    known = existing.select(key, F.struct(*names).alias("_known"), F.lit(True).alias("_there"))
    judged = incoming.withColumn("_new", F.struct(*names)).join(known, key, "left")
    judged = judged.withColumn("_fresh", F.col("_there").isNull())
    return judged.filter(F.col("_fresh") | ~F.col("_new").eqNullSafe(F.col("_known"))).drop("_known", "_new", "_there")


def append_records(existing: DataFrame, incoming: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Records to append, and conflicts: a known key with different content. Contents are compared field by field, null like null."""
    judged = news(existing, incoming, key)
    return judged.filter("_fresh").drop("_fresh"), judged.filter("NOT _fresh").drop("_fresh")


def append_to_log(spark: SparkSession, path: str, incoming: DataFrame, key: str) -> DataFrame:
    """Append what is new to an append-only log and return the conflicts, which stay out; known records are no news.

    The decision is made in one join and written before the log grows, so a run that is
    repeated after a failure decides over the same log or finds everything known.
    """
    judged = staged(news(read_or_empty(spark, path, incoming.schema), incoming, key), "news")
    judged.filter("_fresh").drop("_fresh").write.mode("append").option("compression", "zstd").parquet(path)
    return judged.filter("NOT _fresh").drop("_fresh")


def merge_sources(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of several source kinds under one schema, earlier kinds taking precedence."""
    return union_by_precedence(sources, keys)


def write_archives(lines: DataFrame, path: str, header: str | None = None) -> DataFrame:
    """Zipped CSV dumps, one archive per `archive` name with its `line`s by `position`; returns (archive, lines, hash).

    An archive holds one instrument's lines of one period, so a group is bounded by
    the calendar. Its lines stay an Arrow table and are compressed in parts. Files go
    through `pyarrow.fs`, to a folder every executor can reach.
    """
    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        name = key[0].as_py()
        # Lines of the same position are ordered, too, so that a retry writes the same bytes.
        text = table.select(["position", "line"]).sort_by([("position", "ascending"), ("line", "ascending")])["line"]
        content = io.BytesIO()
        with zipfile.ZipFile(content, "w") as archive:
            member = zipfile.ZipInfo(f"{name}.csv")  # with a fixed time, as above
            member.compress_type = zipfile.ZIP_DEFLATED
            with archive.open(member, "w", force_zip64=True) as file:
                if header:
                    file.write(f"{header}\n".encode())
                for at in range(0, len(text), 10_000):
                    file.write("".join(f"{t}\n" for t in text.slice(at, 10_000).to_pylist()).encode())
        system, place = filesystem.FileSystem.from_uri(path) if ":" in path else (filesystem.LocalFileSystem(), path)
        system.create_dir(place, recursive=True)
        with system.open_output_stream(f"{place}/{name}.zip") as out:
            out.write(content.getbuffer())
        return pa.table({"archive": [name], "lines": pa.array([len(text)], pa.int64()), "hash": [hashlib.sha256(content.getbuffer()).hexdigest()]})

    return staged(lines.groupBy("archive").applyInArrow(pack, "archive string, lines bigint, hash string"), "archives")


def zipped_lines(spark: SparkSession, path: str, header: str | None = None) -> DataFrame:
    """(archive, line) of zipped CSV dumps, without the header line where a dump has one.

    Archives are binary rows, dealt out one by one; a member is read line by line.
    """
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        with archive.open(member) as file:
                            text = (raw.decode("utf-8").strip() for raw in file)
                            wanted = (t for t in text if t and not (header and t.startswith(header)))
                            while part := list(itertools.islice(wanted, 10_000)):
                                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(part)], ["path", "line"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    spread = files.select("path", "content").repartition(max(1, files.select("path").count()))
    stem = F.regexp_extract("path", r"([^/]+)\.zip$", 1)
    return spread.mapInArrow(lines, "path string, line string").select(stem.alias("archive"), "line")


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSONL files under a declared schema, and the lines that are no JSON of it; parsed once, for both."""
    both = staged(spark.read.schema(f"{schema}, _line string").option("columnNameOfCorruptRecord", "_line").json(path), "json")
    return both.filter(F.col("_line").isNull()).drop("_line"), both.filter(F.col("_line").isNotNull()).select(F.col("_line").alias("line"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, hash): SHA-256 of every data file under a path, by its place below it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    root = path.rstrip("/").rsplit("/", 1)[-1]
    return files.select(F.substring_index("path", f"/{root}/", -1).alias("file"), F.sha2("content", 256).alias("hash"))


def publish_with_manifest(rows: DataFrame, path: str, partitions: Sequence[str]) -> DataFrame:
    """An immutable partitioned dataset with the hash of each file beside it; returns the manifest."""
    rows.repartition(*partitions).write.mode("errorifexists").option("compression", "zstd").partitionBy(*partitions).parquet(path)
    file_hashes(rows.sparkSession, path).write.mode("errorifexists").parquet(f"{path.rstrip('/')}-manifest")
    return rows.sparkSession.read.parquet(f"{path.rstrip('/')}-manifest")


def move_into(spark: SparkSession, folder: str, file: str) -> None:
    """Put the one data file of a written folder in the place of another file."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(file).getFileSystem(spark._jsc.hadoopConfiguration())
    part = system.globStatus(path(f"{folder}/part-*"))[0].getPath()
    system.delete(path(file), False)
    if not system.rename(part, path(file)):
        raise OSError(f"{part} could not replace {file}")


def audit(spark: SparkSession, path: str) -> DataFrame:
    """(file, reason): files that are missing, mismatched or unlisted against the published manifest."""
    return integrity_reasons(file_hashes(spark, path), spark.read.parquet(f"{path.rstrip('/')}-manifest"), ["file"])


def single_day_violations(tail: DataFrame, keys: Sequence[str], day: str, expected: str) -> DataFrame:
    """Tail dumps that do not hold exactly one row for the requested day."""
    return tail.groupBy(*keys, expected).agg(
        F.count("*").alias("rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day")
    ).filter((F.col("rows") != 1) | (F.col("first_day") != F.col(expected)))


def latest_confirmed(bars: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """The latest `limit` confirmed unique bars per key."""
    from pyspark.sql import Window as W

    newest = W.partitionBy(*keys).orderBy(F.desc("open_time_ns"))
    unique = bars.filter("confirmed").dropDuplicates([*keys, "open_time_ns"])
    return unique.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= limit).drop("_rank")
