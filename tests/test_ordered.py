"""Ordered streams: the book's rules by hand, and micro-batches with shuffled and late files against the plain order."""

import datetime
import random

from pyspark.sql import functions as F

from tidepanel.catalog import q_ordered
from tidepanel.streaming import monitors, ordered


def test_book_rules():
    book = ordered.Book()
    assert book.apply("update", 2, 1, [], []) == ("invalid", None, None)  # no snapshot yet
    assert book.apply("snapshot", 3, None, [(1.0, 2.0), (0.5, 1.0)], [(2.0, 1.0)]) == ("valid", 1.0, 2.0)
    assert book.apply("update", 4, 3, [(1.0, 0.0)], [(1.5, 3.0)]) == ("valid", 0.5, 1.5)
    book = ordered.Book(book.dump())  # as state brings it back
    assert book.apply("update", 5, 4, [(0.7, 0.0)], [(2.0, 0.0), (1.5, 0.0)]) == ("valid", 0.5, None)
    assert book.apply("update", 7, 6, [], []) == ("invalid", None, None)  # gap
    assert book.apply("update", 8, 7, [], []) == ("invalid", None, None)  # until the next snapshot
    assert book.apply("snapshot", 9, None, [(3.0, 1.0)], [(2.0, 1.0)]) == ("invalid", None, None)  # crossed snapshot
    assert book.apply("snapshot", 10, None, [(1.0, 1.0)], [(2.0, 1.0)]) == ("valid", 1.0, 2.0)
    assert book.apply("update", 11, 10, [(2.0, 1.0)], []) == ("invalid", None, None)  # crossed by a delta


LEVELS = "array<struct<price double, quantity double>>"
SCHEMA = f"instrument_id string, event_time timestamp, action string, sequence bigint, previous_sequence bigint, bids {LEVELS}, asks {LEVELS}"


def message(name, s, draw):
    at = datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=10 * s)
    bids = [(float(draw.randrange(1, 50)), float(draw.choice([0, 1, 2])))]
    return (name, at, "snapshot" if s % 6 == 1 else "update", s, None if s % 6 == 1 else s - 1, bids, [(float(draw.randrange(45, 99)), 1.0)])


def test_micro_batches_out_of_order(spark, tmp_path):
    draw = random.Random(4)
    sent = {n: [message(n, s, draw) for s in range(1, 61) if s % 11] for n in "ab"}
    path = str(tmp_path / "landing")
    for start in (20, 0, 40):  # the second file is behind the first by less than the delay
        part = [m for n in "ab" for m in sent[n] if start < m[3] <= start + 20]
        draw.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    copy = sent["a"][0][:1] + (datetime.datetime(2024, 1, 1, 1),) + sent["a"][2][2:]  # an old sequence under a new time
    beat = ("beat", datetime.datetime(2024, 2, 1), "update", 0, None, [], [])
    stream = lambda: monitors.read_landing(spark, path, spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)
    out = str(tmp_path / "out")
    first = monitors.drain_to(ordered.ordered_books(stream(), "5 minutes"), out).count()
    assert 0 < first < 110  # what the watermark has not passed waits in the checkpoint
    spark.createDataFrame([copy, beat], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    got = monitors.drain_to(ordered.ordered_books(stream(), "5 minutes"), out).filter("instrument_id <> 'beat'")
    rows = sorted(tuple(r) for r in got.collect())
    want = []
    for n in "ab":
        book = ordered.Book()
        want += [(n, m[3], *book.apply(m[2], m[3], m[4], m[5], m[6])) for m in sent[n]]
    assert [r for r in rows if r[2] != "late"] == sorted(want)
    assert [r for r in rows if r[2] == "late"] == [("a", copy[3], "late", None, None)]
    assert {r[2] for r in want} == {"valid", "invalid"}


def test_chain_goes_on_after_a_restart(spark, tmp_path):
    path, out = str(tmp_path / "landing"), str(tmp_path / "out")
    rows = [(i % 2, i, "xy"[i % 3 == 0], f"p{i}") for i in range(24)]
    schema = "chain_id bigint, event_id bigint, kind string, payload string"
    run = lambda: monitors.drain_to(ordered.chained(monitors.read_landing(spark, path, spark.createDataFrame([], schema).schema, files_per_trigger=1)), out)
    for part in (rows[:10], rows[10:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        run()
    for chain in (0, 1):
        link, latest = ordered.FIRST_LINK, {}
        for n, r in enumerate(sorted(run().filter(F.col("chain_id") == chain).collect(), key=lambda r: r.sequence), 1):
            latest[r.kind] = r.payload
            snapshot = ",".join(f"{k}={latest[k]}" for k in sorted(latest)) if n % 5 == 0 else None
            assert (r.sequence, r.event_id, r.snapshot, r.previous_hash) == (n, 2 * (n - 1) + chain, snapshot, link)
            link = ordered.record_hash(chain, n, r.kind, r.payload, snapshot, link)
            assert r.content_hash == link
        assert n == 12


def test_keys_of_a_shard_share_its_state(spark, tmp_path):
    path, out = str(tmp_path / "landing"), str(tmp_path / "out")
    keys = [1, 2**60 + 1, None]
    rows = [(keys[i % 3], i, "x", f"p{i}") for i in range(18)]
    schema = "chain_id bigint, event_id bigint, kind string, payload string"
    for part in (rows[:10], rows[10:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        stream = monitors.read_landing(spark, path, spark.createDataFrame([], schema).schema, files_per_trigger=1)
        got = monitors.drain_to(ordered.chained(stream, shards=1), out).collect()
    for k, chain in enumerate(keys):
        link = ordered.FIRST_LINK
        for n, r in enumerate(sorted((r for r in got if r.chain_id == chain), key=lambda r: r.sequence), 1):
            assert (r.sequence, r.event_id, r.previous_hash) == (n, 3 * (n - 1) + k, link)
            link = r.content_hash
            assert link == ordered.record_hash(chain, n, "x", r.payload, r.snapshot, r.previous_hash)
        assert n == 6


def test_a_slice_lands_in_files_that_hold_whole_keys(spark, tmp_path):
    path = str(tmp_path / "landing")
    rows = spark.range(600).selectExpr("id", "id % 7 AS k", "id DIV 300 AS part")
    q_ordered.land(rows, F.col("part"), [1, 0], path, "k", 3)
    read = spark.read.parquet(path).withColumn("file", F.input_file_name()).groupBy("part", "k").agg(F.countDistinct("file").alias("files"), F.count("*").alias("n"))
    assert {(r.files, r.n) for r in read.collect()} <= {(1, 42), (1, 43)}
    assert len(list((tmp_path / "landing").glob("*.parquet"))) > 2
