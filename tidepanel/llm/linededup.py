"""Line dedup over repeated runs of lines, all in DataFrame functions.

The corpus is one sequence of line ids, numbered by doc_id, row and line, that
breaks at documents. Prefix doubling names the runs of 2^k lines: two positions
have the same name if their runs are equal, and the name is the first of these
positions. A run of any other length is named by the two power-of-two runs that
overlap to it. A name's positions are the suffix array's interval of a common
prefix of at least so many lines; the order of different intervals is never used,
so names need not be sorted, only agree. Positions whose run occurs once leave
the game.

Of every maximal repeated run with `MIN_WORDS` words or more, all copies but the
first go. A line of such a copy also lies in a repeated run with as many words of
at most `MIN_WORDS` lines: a longer one keeps enough words without one of its
ends, as every line has a word. And each part of a later copy is a later copy. So
intervals deeper than `MIN_WORDS` lines change nothing, doubling ends there
however long the copies are, and the shallow ones together cover the same lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import BLANKS, discard, written

MIN_WORDS = 5


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def numbered(docs: DataFrame) -> DataFrame:
    """(at, id, line, rest, a, b, words) of every line with a word: its number in the corpus, its row's id, its place in the text,
    how many such lines follow in the text, its 128-bit id, and its words. Blanks at its ends do not count."""
    listed = F.transform(lines_of(F.col("text")), lambda x, i: F.struct(i.alias("line"), F.trim(F.regexp_replace(x, f"{BLANKS}+", " ")).alias("x")))
    rows = docs.select(F.monotonically_increasing_id().alias("id"), F.col("doc_id").cast("long"), F.filter(listed, lambda s: s["x"] != "").alias("of"))
    each = rows.select("id", "doc_id", F.size("of").alias("n"), F.posexplode("of").alias("pos", "s")).select(
        "id", "doc_id", F.col("s.line").alias("line"), (F.col("n") - F.col("pos") - 1).alias("rest"),
        F.xxhash64("s.x").alias("a"), F.xxhash64(F.lit(1), "s.x").alias("b"), F.size(F.split("s.x", " ")).alias("words"))
    each, path = written(each, "rawlines")
    sorted_rows = each.repartitionByRange("doc_id", "id").sortWithinPartitions("doc_id", "id", "line")
    out, _ = written(sorted_rows.select(F.monotonically_increasing_id().alias("at"), "id", "line", "rest", "a", "b", "words"), "lines")
    discard(docs.sparkSession, path)
    return out


def named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur more than once, with `name`, the first position that has them."""
    groups = rows.groupBy(*keys).agg(F.min("at").alias("name"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(groups, keys).drop(*keys)


def earlier_runs(active: DataFrame, most: int) -> DataFrame:
    """(at, m): for positions whose run also begins earlier, how many lines of it do, counted up to `most`."""
    levels = {1: active.select("at", "rest", "name")}
    for size in range(2, most + 1):
        half = 1 << (size - 1).bit_length() - 1  # the largest power of two below it
        first = levels[half].where(F.col("rest") >= size - 1).withColumnRenamed("name", "first")
        second = levels[half].select((F.col("at") - (size - half)).alias("at"), F.col("name").alias("second"))
        levels[size], _ = written(named(first.join(second, "at"), ["first", "second"]), "runs")
    found = None
    for size, level in levels.items():
        mine = level.where("name < at").select("at", F.lit(size).alias("m"))
        found = mine if found is None else found.union(mine)
    return found.groupBy("at").agg(F.max("m").alias("m"))


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, line, upto): ranges of lines to delete, from `line` up to and with `upto`, by row id."""
    lines = numbered(docs)
    active, _ = written(named(lines.select("at", "id", "line", "rest", "words", "a", "b"), ["a", "b"]), "active")
    most = max(min_words, 1)
    found = earlier_runs(active, most)
    inside = Window.partitionBy("id").orderBy("at")
    # The lines of a run follow one another here, so its last one is `m - 1` rows ahead.
    rows = active.select("at", "id", "line", "words").join(found, "at", "left").withColumn("sum", F.sum("words").over(inside))
    ahead = F.array(*(F.lead("sum", i).over(inside) for i in range(most)))
    reach = F.when(F.get("ahead", F.col("m") - 1) - F.col("sum") + F.col("words") >= min_words, F.col("at") + F.col("m"))
    covered = (rows.withColumn("ahead", ahead).withColumn("reach", F.max(reach).over(inside)).where("reach > at")
               .withColumn("block", F.col("at") - F.row_number().over(inside)))
    return covered.groupBy("id", "block").agg(F.min("line").alias("line"), F.max("line").alias("upto")).drop("block")


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of `docs` with its `text` less the later copies of repeated line runs.

    Two more columns: `n_lines`, and `n_deleted` of them. Lines are compared
    with their blanks squeezed; lines without words belong to no run, but go with
    a run around them. Of equal runs the one in the smallest doc_id (nulls first)
    and there at the earliest place is the first. Rows never go, even if no line
    is left; a null text stays null and counts no lines. Of repeated rows one
    keeps its lines. `docs` has to give the same rows in the same order when it is
    read again, as a table does. Columns named n_lines or n_deleted are replaced.
    """
    ranges = deletions(docs, min_words).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("line", "upto"))).alias("__cut"))
    rows = docs.drop("n_lines", "n_deleted").withColumn("__id", F.monotonically_increasing_id())
    joined = rows.join(ranges.withColumnRenamed("id", "__key"), F.col("__id") == F.col("__key"), "left").drop("__key", "__id")
    lines, cut = lines_of(F.col("text")), F.col("__cut")
    # What stays lies between one range and the next.
    starts = F.concat(F.array(F.lit(0)), F.transform(cut, lambda r: r["upto"] + 1))
    ends = F.concat(F.transform(cut, lambda r: r["line"]), F.array(F.size("__lines")))
    kept = F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice("__lines", s + 1, e - s)))
    out = joined.withColumn("__lines", lines)
    deleted = F.aggregate(cut, F.lit(0), lambda n, r: n + r["upto"] - r["line"] + 1)
    return (out.withColumn("text", F.when(cut.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
            .withColumn("n_lines", F.coalesce(F.when(F.col("__lines").isNotNull(), F.size("__lines")), F.lit(0)))
            .withColumn("n_deleted", F.coalesce(deleted, F.lit(0))).drop("__lines", "__cut"))
