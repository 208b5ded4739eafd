"""Endpoint merges, health and gated receipts on rows made by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import chain, endpoints, microstructure, quality

ENDPOINTS = ("premium", "book")


def test_rounds_of_one_side_stay(spark):
    left = spark.createDataFrame([("a", 1, 0.1, 5.0), ("a", 2, 0.3, 7.0), ("b", 1, None, 1.0)], "s string, round int, rate double, basis_bps double")
    right = spark.createDataFrame([("a", 2, 2.0), ("a", 3, 4.0), ("c", 1, 6.0)], "s string, round int, spread_bps double")
    merged = endpoints.merge_rounds(left, right, ["s", "round"])
    assert {(r.s, r["round"]): r.origin for r in merged.collect()} == {
        ("a", 1): "left_only", ("a", 2): "both", ("a", 3): "right_only", ("b", 1): "left_only", ("c", 1): "right_only"}
    got = {r.s: r for r in endpoints.symbol_means(merged, "s", "round").collect()}
    a = got["a"]
    assert (a.premium_rounds, a.book_rounds, a.shared_rounds) == (2, 2, 1)
    # The last rate is that of the last round which the first endpoint had.
    assert (a.mean_rate, a.last_rate, a.mean_basis_bps, a.mean_spread_bps) == pytest.approx((0.2, 0.3, 6.0, 3.0))
    assert got["b"].mean_rate is None and got["b"].mean_spread_bps is None and got["b"].premium_rounds == 1
    assert got["c"].mean_rate is None and got["c"].mean_spread_bps == 6.0 and got["c"].premium_rounds == 0


def test_last_reading_of_a_round(spark):
    rows = spark.createDataFrame([("a", 1, 5, 1.0), ("a", 1, 9, None), ("a", 2, 1, 3.0)], "s string, round int, at int, v double")
    got = {r["round"]: r.v for r in endpoints.last_of_round(rows, ["s", "round"], ["at"], ["v"]).collect()}
    assert got == {1: None, 2: 3.0}


def segment(journal, sequence, failures=(), excluded=None, failed=0):
    return (journal, sequence, sequence * 10, list(failures), excluded or {}, 4, failed)


def test_health_is_a_rate_over_rounds_that_asked(spark):
    rows = spark.createDataFrame([
        segment("j", 1, ["book:old"], {"book": 99}, 4), segment("j", 2, ["book:timeout", "premium:x"], {"book": 2}, 1), segment("j", 3),
        segment("j", 4, ["book:timeout"], {"premium": 1}, 1), segment("k", 1, [], {}, 4),
    ], "j string, sequence long, received_time_ns long, failures array<string>, excluded map<string, int>, depth_asked int, depth_failed int")
    got = {(r.j, r.endpoint): r for r in endpoints.endpoint_health(rows, "j", ENDPOINTS, last=3, every=2).collect()}
    book, premium = got["j", "book"], got["j", "premium"]
    # The first segment is out of the window; rounds 2 and 4 asked.
    assert (book.rounds, book.snapshot_rounds, book.failures, book.failure_rate, book.excluded_total) == (3, 2, 2, 1.0, 2)
    assert (premium.failures, premium.failure_rate, premium.excluded_total) == (1, 0.5, 1)
    assert book.depth_failure_rate == pytest.approx(2 / 12) and (book.last_sequence, book.newest_ns) == (4, 40)
    # No round asked: the rate is zero, the depth rate is not.
    assert got["k", "book"].failure_rate == 0.0 and got["k", "book"].depth_failure_rate == 1.0


def test_receipts_are_refused_behind_a_fault(spark):
    def records(name, n, bad=None, lost=None):
        hashed = [hashlib.sha256(f"{name}{i}".encode()).hexdigest() for i in range(1, n + 1)]
        return [(name, i, h, "x" if i == bad else h, hashed[i - 2] if i > 1 else chain.ZERO_HASH)
                for i, h in enumerate(hashed, 1) if i != lost]

    rows = spark.createDataFrame(records("sound", 3) + records("forged", 3, bad=2) + records("gap", 4, lost=3) + records("idle", 1),
                                 "chain_id string, sequence long, recomputed string, content_hash string, previous_hash string")
    figures = spark.createDataFrame([("sound", 7), ("forged", 8), ("gap", 9)], "chain_id string, measured long")
    got = {r.chain_id: r for r in endpoints.gated_receipt(rows, F.col("recomputed"), figures, ["measured"]).collect()}
    assert (got["sound"].status, got["sound"].measured, got["sound"].reasons) == ("sealed", 7, "")
    assert (got["forged"].status, got["forged"].measured) == ("refused", None)
    assert got["forged"].reasons == "CHAIN_LINK_BROKEN,SEGMENT_HASH_MISMATCH" and got["forged"].faulty_segments == 2
    assert got["gap"].status == "refused" and "SEGMENT_SEQUENCE_GAP" in got["gap"].reasons
    assert got["idle"].status == "nothing_measured" and got["idle"].measured is None


def test_exit_gate_tells_every_reason(spark):
    exits = spark.createDataFrame([(0, 2), (20, 1), (40, 0)], "day long, with_bar long")
    got = [r.reasons for r in quality.exit_gate(exits, F.lit(2), F.lit("1970-01")).orderBy("exit_ns").collect()]
    assert got == ["", "EXIT_BAR_INCOMPLETE", "EXIT_BAR_MISSING,COVERAGE_MONTH_NOT_REACHED"]


def test_ranks_of_both_tiers_are_sampled(spark):
    pairs = spark.range(1, 41).select(F.lit(5).alias("decision_ns"), F.col("id").alias("liquidity_rank"), F.concat(F.lit("s"), "id").alias("spot_contract"),
                                      F.concat(F.lit("p"), "id").alias("perp_contract"))
    got = {(r.sample_tier, r.liquidity_rank, r.market) for r in microstructure.stratified_sample(pairs).collect()}
    ranks = [(1, r) for r in range(1, 9)] + [(2, r) for r in (9, 12, 15, 19, 23, 27, 31, 35)]
    assert got == {(tier, rank, market) for tier, rank in ranks for market in ("spot", "perp")}
