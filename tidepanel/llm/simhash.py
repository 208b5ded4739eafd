"""Near-duplicates by SimHash fingerprints in sharded BK-trees.

Links are looked for between distinct fingerprints, so copies cost nothing. Two
fingerprints within the radius agree on one of `radius + 1` blocks of their bits,
and the rest agrees on one of `radius + 1` blocks again: a shard holds the
fingerprints that agree on such a pair of blocks, about 36 of 64 bits. Each
shard's BK-tree goes, by shuffle, to the task that holds its queries. (Shards
together are as many as the fingerprints, so a broadcast through the driver
would pass all of them through it.) A shard beyond `TREE` fingerprints is cut
into several trees, and each of its fingerprints asks every tree of the shard up
to its own; trees of one shard then stand in different tasks. A task returns no
pairs but one link from each fingerprint to the first of its class there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import bktree
from tidepanel.llm.common import discard, map_batches, written
from tidepanel.llm.graph import components

SHINGLE = 3
RADIUS = 2
SEED = 42
TREE = 4096
BLOCK = 1 << 16
_split = re.compile(rb"[^\x20\x09-\x0D]+").findall


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    found = _split(text.lower())  # of bytes, this lower-cases A-Z only
    if not found:
        return 0
    size = min(words, len(found))
    ones, total = np.zeros(64, np.int64), len(found) - size + 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, BLOCK):
        part = found[at:at + BLOCK + size - 1]
        hashes = np.array([digest(b" ".join(s), SEED) for s in zip(*(part[i:] for i in range(size)), strict=False)], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(id, doc_id, fp) of every row, `id` being its place in the scan; a null text has no words and fingerprint zero."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = [fingerprint(t.as_py() or b"", words) for t in batch["text"].cast(pa.binary())]
        return pa.RecordBatch.from_arrays([batch["id"], batch["doc_id"], pa.array(np.array(prints, np.uint64).view(np.int64))], ["id", "doc_id", "fp"])

    rows = docs.select(F.monotonically_increasing_id().alias("id"), F.col("doc_id").cast("long"), "text")
    return map_batches(rows, each, "id long, doc_id long, fp long")


def _ranges(bits: list[int], parts: int) -> list[list[int]]:
    cut = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def masks(radius: int) -> list[int]:
    """Signed 64-bit masks of which two fingerprints within the radius agree on at least one."""
    out = []
    for block in _ranges(list(range(64)), radius + 1):
        for inner in _ranges([b for b in range(64) if b not in block], radius + 1):
            mask = sum(1 << b for b in block + inner)
            out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def links(distinct: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """(a, b) links between distinct fingerprints `fp`, enough to connect all that are within the radius."""
    keyed = distinct.select("fp", F.explode(F.array(*(
        F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks(radius))))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowds = sizes.select("key", F.ceil(F.col("n") / tree).cast("int").alias("trees"))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("trees")).cast("int")
    seated = keyed.join(crowds, "key").withColumn("own", own)
    rows = seated.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), "own")).alias("tree")).select(
        F.xxhash64("key", "tree").alias("shard"), "fp", (F.col("own") == F.col("tree")).alias("member"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shard = batch["shard"].to_numpy()
            cut = int(np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])[-1])
            if held and shard[0] != held[0]["shard"][-1].as_py() or cut:
                yield found([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield found(held)

    def found(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        block = pa.Table.from_batches(parts)
        fp = block["fp"].to_numpy()
        # A tree takes its members in the order of the fingerprints, so a retried task builds the same one.
        label = bktree.linked(fp.view(np.uint64), block["shard"].to_numpy(), block["member"].to_numpy(), radius)
        moved = label != np.arange(len(label))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[label[moved]])], ["a", "b"])

    return rows.repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(run, "a long, b long").distinct()


def classes(docs: DataFrame, words: int = SHINGLE, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(id, doc_id, fp) of every row, and (fp, root, component_id) of every fingerprint, both written."""
    prints, _ = written(fingerprints(docs, words), "prints")
    distinct, _ = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found, links_path = written(links(distinct, radius), "bklinks")
    nodes = components(found, "a", "b")
    discard(docs.sparkSession, links_path)
    firsts = nodes.join(distinct, nodes.node == distinct.fp).groupBy("root").agg(F.min("first").alias("component"))
    named = nodes.join(firsts, "root").select(F.col("node").alias("fp"), "root", "component")
    every = distinct.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "first").alias("component_id"))
    return prints, written(every, "classes")[0]


def near_duplicates(docs: DataFrame, words: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of (doc_id, text).

    component_id is the smallest doc_id that is reachable over fingerprints at
    most `radius` bits apart. Repeated rows stay and fall together. Rows with a
    null doc_id link like any other and name no component (null if there is no
    other row in it). Texts without words have fingerprint zero, linked like any
    other.
    """
    prints, named = classes(docs, words, radius)
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, words: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of `docs` of each component, as it was: that of the smallest doc_id, and of repeats the first.

    `docs` has to give the same rows in the same order when it is read again, as a table does.
    """
    prints, named = classes(docs, words, radius)
    best = prints.join(named, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("id").alias("__stays"))
    rows = docs.withColumn("__id", F.monotonically_increasing_id())
    return rows.join(best.select("__stays"), F.col("__id") == F.col("__stays"), "left_semi").drop("__id")
