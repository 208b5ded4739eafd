"""Benchmark decontamination: a prefix-filtered containment join, all in DataFrame functions.

An item is cut into windows of `WINDOW` consecutive words (an item of fewer is
one window), and a window is a set of word shingles. Full containment in a
document needs every shingle of the window, so the prefix that must be shared is
one: the window's rarest shingle, by counts over all documents. Only these are
joined. A candidate then has to fit by length and position, and is verified word
by word.

The benchmark side of both joins is broadcast in blocks of at most
`BLOCK_WINDOWS` distinct windows, each counted first; a larger benchmark takes
more passes over the documents. Documents are never shuffled, only their hits:
each document sends one row ahead, so those without hits stay in the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import ascii_lower, written

WINDOW = 10
SHINGLE = 5
BLOCK_WINDOWS = 50_000
#: Everything between words once A-Z is lower-case: all of ASCII but digits and letters.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, lower-cased; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_at(hashes: Column, at: Column, size: int, count: Column) -> Column:
    """Hash of the `size` words from place `at` (from 0) on, null where they do not fit in `count` words."""
    return F.when(at + size <= count, F.xxhash64(*(F.get(hashes, at + i) for i in range(size))))


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(words, n, items): the distinct windows and the ids, as strings, of the items they stand in; a null id is 'null'."""
    worded = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words_of(F.col("text")).alias("all"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (window - 1), F.lit(1)))
    each = worded.where(F.size("all") > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice("all", i, window))).alias("words"))
    return each.groupBy("words").agg(F.collect_set("item").alias("items")).select("words", F.size("words").alias("n"), "items")


def hits(worded: DataFrame, windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, start, n, items) of every occurrence of a window in a document, and one row with a null start per document.

    `worded` has (id, words); `windows` must be of broadcast size. `start` counts from 1.
    """
    spark = worded.sparkSession
    sizes = sorted(r.size for r in windows.select(F.least(F.lit(shingle), "n").alias("size")).distinct().collect())  # 1 to `shingle` at most
    each = windows.select("words", "n", hashed(F.col("words")).alias("h")).select("*", F.posexplode("h").alias("offset", "w"))
    grams = spark.createDataFrame([], "words array<string>, offset int, gram long")
    for s in sizes:
        own = each.where(F.least(F.lit(shingle), "n") == s)
        grams = grams.union(own.select("words", "offset", shingle_at(F.col("h"), F.col("offset"), s, F.col("n")).alias("gram")).where("gram IS NOT NULL"))
    # Place 0 stands for the document itself, with gram 0; words count from 1.
    placed = worded.select("id", "words", F.concat(F.array(F.lit(0).cast("long")), hashed(F.col("words"))).alias("h")).select(
        "*", F.posexplode("h").alias("pos", "w"))
    place, count = F.col("pos"), F.size("words") + 1
    found = [F.when(place > 0, shingle_at(F.col("h"), place, s, count)) for s in sizes] or [F.lit(None).cast("long")]
    found[0] = F.when(place == 0, F.lit(0).cast("long")).otherwise(found[0])
    placed = placed.select("id", "words", "pos", (found[0] if len(found) == 1 else F.explode(F.array(*found))).alias("gram"))
    counted = (placed.select("gram").join(F.broadcast(grams.select("gram").distinct()), "gram")
               .groupBy("gram").agg(F.count("*").alias("seen")))
    rarest = (grams.join(counted, "gram", "left").groupBy("words")
              .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "gram", "offset")).alias("r"))
              .select("words", "r.gram", "r.offset"))
    prefix = (windows.join(rarest, "words").select("gram", "offset", F.col("words").alias("wanted"), "n", "items")
              .unionByName(spark.range(1).select(F.lit(0).cast("long").alias("gram")), allowMissingColumns=True))
    prefix, _ = written(prefix, "prefix")
    occurring = (placed.join(F.broadcast(prefix), "gram").where((F.col("pos") == 0) == F.col("n").isNull())
                 .withColumn("start", F.col("pos") - F.col("offset"))
                 .where("n IS NULL OR (start >= 1 AND start + n - 1 <= size(words))")
                 .where("n IS NULL OR slice(words, start, n) = wanted"))
    return occurring.select("id", F.when(F.col("n").isNotNull(), F.col("start")).alias("start"), "n", "items",
                            F.when(F.col("n").isNull(), F.size("words")).alias("n_words"))


def covered(runs: Column) -> Column:
    """How many positions a set of (start, n) runs covers."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit"))
    return F.aggregate(F.sort_array(runs), zero, lambda a, r: F.struct(
        F.greatest(a["end"], r["start"] + r["n"]).alias("end"),
        (a["hit"] + F.greatest(F.lit(0), r["start"] + r["n"] - F.greatest(a["end"], r["start"]))).alias("hit")), lambda a: a["hit"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """(id, doc_id, n_words, n_hit, n_items, items, contaminated) of every row of (doc_id, text).

    A null text has no words, as has a null item text; such items have no
    windows. Items that repeat an id count as one; a null item id is named
    'null'. Repeated document rows stay, each with an `id` of its own (its place
    in the scan). `items` is sorted as strings.
    """
    windows, _ = written(windows_of(items, window), "windows")
    blocks = max(1, math.ceil(windows.count() / block))
    worded = docs.select(F.monotonically_increasing_id().alias("id"), F.col("doc_id").cast("long"), words_of(F.col("text")).alias("words"))
    found = None
    for b in range(blocks):
        part = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b)
        named = hits(worded.select(F.struct("id", "doc_id").alias("id"), "words"), part)
        found = named if found is None else found.union(named)
    runs = F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "n")))
    whole = found.groupBy("id").agg(F.max("n_words").alias("n_words"), runs.alias("runs"), F.collect_set("items").alias("named"))
    return whole.select(
        "id.id", "id.doc_id", F.col("n_words").cast("long"), covered(F.col("runs")).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten("named"))).alias("items")).select(
        "id", "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    return contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` in which no window of the benchmark occurs, as they were."""
    # The same scan gives the same ids, and only ids of contaminated rows are shuffled to them.
    bad = contamination(docs, items).where("contaminated").select(F.col("id").alias("__bad"))
    return docs.withColumn("__id", F.monotonically_increasing_id()).join(bad, F.col("__id") == F.col("__bad"), "left_anti").drop("__id")
