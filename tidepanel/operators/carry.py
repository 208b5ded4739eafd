"""Two-leg pairs: universes, cohorts and slot books."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions.timefns import WEEK_NS
from tidepanel.operators.accounting import CostTable
from tidepanel.operators.universe import UniverseRules, screen_contracts
from tidepanel.operators.weights import seeded_score


@dataclass(frozen=True)
class PairRules:
    leg: UniverseRules  # contract caps and floors of `leg` are not applied
    minimum_pairs: int
    maximum_pairs: int
    tier_one_rank_limit: int


@dataclass(frozen=True)
class Selection:
    minimum_selected: int
    decile_denominator: int


def perp_leg(contract: Column) -> Column:
    return F.concat(F.lit("perp:"), contract)


def spot_leg(contract: Column) -> Column:
    return F.concat(F.lit("spot:"), contract)


def leg_market(leg: Column) -> Column:
    return F.when(leg.startswith("spot:"), "spot").otherwise("perp")


def select_pairs(legs: DataFrame, pairs: DataFrame, rules: PairRules) -> DataFrame:
    """Eligible pairs per decision, re-ranked by the perpetual leg's liquidity.

    `pairs` names perpetual and spot instruments. A pair's cost tier is the
    worse of its perpetual rank tier and its spot leg's tier among spot legs.
    """
    screened = screen_contracts(legs, rules.leg).withColumn(
        "market", leg_market(F.col("contract_id"))
    )
    spot_rank = F.row_number().over(
        W.partitionBy("decision_ns").orderBy(F.desc("median_quote_volume"), "contract_id")
    )
    spot = screened.filter("market = 'spot'").select(
        "decision_ns", F.col("instrument_id").alias("spot"), F.col("contract_id").alias("spot_contract"),
        F.when(spot_rank <= rules.tier_one_rank_limit, 1).otherwise(2).alias("spot_tier"),
    )
    perp = screened.filter("market = 'perp'").select(
        "decision_ns", F.col("instrument_id").alias("perpetual"), F.col("contract_id").alias("perp_contract"),
        "median_quote_volume",
    )
    cell = W.partitionBy("decision_ns")
    tier = F.when(F.col("liquidity_rank") <= rules.tier_one_rank_limit, 1).otherwise(2)
    return (
        perp.join(pairs, "perpetual")
        .join(spot, ["decision_ns", "spot"])
        .withColumn("liquidity_rank", F.row_number().over(cell.orderBy(F.desc("median_quote_volume"), "perp_contract")))
        .withColumn("_pairs", F.count("*").over(cell))
        .filter((F.col("_pairs") >= rules.minimum_pairs) & (F.col("liquidity_rank") <= rules.maximum_pairs))
        .select(
            "decision_ns", F.col("perp_contract").alias("pair_id"), "perp_contract", "spot_contract",
            "median_quote_volume", "liquidity_rank", tier.alias("perp_tier"), "spot_tier",
            F.greatest(tier, F.col("spot_tier")).alias("tier"),
        )
    )


def round_trip_bps(cost: CostTable, tier: Column) -> Column:
    """Entering and leaving one unit of pair capital: both fees, slippage twice."""
    slippage = F.when(tier == 1, cost.slippage_tier1_bps).otherwise(cost.slippage_tier2_bps)
    return F.lit((cost.spot_fee_bps or 0.0) + cost.fee_bps) + 2 * slippage


def hurdle(cost: CostTable, tier: Column, *, multiple: Column, lookback_weeks: Column, hold_weeks: Column) -> Column:
    """The smallest trailing sum worth entering for, as a fraction; NULL where a member has no multiple."""
    return 2 * multiple * round_trip_bps(cost, tier) / F.lit(10_000.0) * (lookback_weeks / hold_weeks)


def book_width(eligible: Column, selection: Selection) -> Column:
    """How many pairs a cohort may hold, out of all that are eligible."""
    return F.greatest(F.lit(selection.minimum_selected), F.floor(eligible / F.lit(selection.decile_denominator)).cast("int"))


def rank_paying(eligible: DataFrame, selection: Selection, *, minimum: Column | None = None, group: Sequence[str] = ("decision_ns",)) -> DataFrame:
    """Top-decile positive payers above their hurdle, ranked per group.

    The decile width counts every eligible pair, so the hurdle can only thin
    the ranking. `eligible` carries ``trailing``; a NULL minimum asks for nothing.
    """
    cell = W.partitionBy(*group)
    width = book_width(F.col("_eligible"), selection)
    clears = F.lit(True) if minimum is None else F.coalesce(F.col("trailing") >= minimum, F.lit(True))
    return (
        eligible.withColumn("_eligible", F.count("*").over(cell))
        .filter((F.col("trailing") > 0) & clears)
        .withColumn("_paying", F.count("*").over(cell))
        .filter(F.col("_paying") >= selection.minimum_selected)
        .withColumn("rank", F.row_number().over(cell.orderBy(F.desc("trailing"), "pair_id")))
        .filter(F.col("rank") <= width)
        .drop("_eligible", "_paying")
    )


CONTROLS = ("no_trade", "random_pairs", "all_pairs")


def control_pairs(eligible: DataFrame, selection: Selection, seed: int) -> DataFrame:
    """The pairs of the controls that hold any, under ``member`` and ``rank``; `no_trade` holds none.

    `random_pairs` takes a book's width of pairs in a seeded order; `all_pairs`
    takes every pair that paid. `eligible` carries ``trailing``.
    """
    cell = W.partitionBy("decision_ns")
    drawn = seeded_score(seed, F.col("decision_ns"), F.col("pair_id"))
    random = (
        eligible.withColumn("_n", F.count("*").over(cell))
        .withColumn("rank", F.row_number().over(cell.orderBy(drawn, "pair_id")))
        .filter(F.col("rank") <= book_width(F.col("_n"), selection)).drop("_n")
    )
    paying = eligible.filter("trailing > 0").withColumn("rank", F.row_number().over(cell.orderBy("pair_id")))
    return random.withColumn("member", F.lit("random_pairs")).unionByName(paying.withColumn("member", F.lit("all_pairs")))


def fill_slots(ranked: DataFrame, blocked: DataFrame, *, free: int, group: Sequence[str]) -> DataFrame:
    """The first `free` ranked pairs of each group that are neither held nor skipped."""
    order = W.partitionBy(*group).orderBy("rank", "pair_id")
    open_pairs = ranked.join(blocked, [*group, "pair_id"], "left_anti")
    return open_pairs.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= free).drop("_n")


def live_cohorts(
    entries: DataFrame, calendar: DataFrame, facts: DataFrame, *, book: Sequence[str],
) -> DataFrame:
    """Entries still held at each decision of their fold.

    An entry is exploded to the decisions it could be held at, which makes the
    age condition an equi-join; its own few rows then decide when it ends. It
    ends at a skipped decision, at an untradeable or exit-rule one, and after a
    forced close. Warm-up decisions form entries and end none.

    `entries` has ``formed_ns``, ``pair_id``, and their member's ``hold_weeks`` and
    ``exits``; `facts` has decision_ns, pair_id, ``paid_last_week`` and
    ``closes_forced``, a missing row meaning the pair cannot be traded.
    """
    fold = [c for c in ("fold_index",) if c in calendar.columns]
    reach = entries.withColumn("_age", F.explode(F.sequence(F.lit(0), F.col("hold_weeks") - 1))).withColumn(
        "decision_ns", F.col("formed_ns") + F.col("_age") * F.lit(WEEK_NS)
    )
    in_window = calendar.filter(~F.col("is_warm_up")).select(*fold, "decision_ns", "skipped")
    met = reach.join(in_window, [*fold, "decision_ns"]).join(
        facts.select("decision_ns", "pair_id", "paid_last_week", "closes_forced"), ["decision_ns", "pair_id"], "left"
    )
    removed = F.when(F.col("paid_last_week").isNull(), True).otherwise(~F.col("paid_last_week") & F.col("exits"))
    path = W.partitionBy(*book, "pair_id", "formed_ns").orderBy("decision_ns")
    ends_now = (F.col("skipped") & (F.col("_age") > 0)) | removed
    ended = F.max(ends_now).over(path.rowsBetween(W.unboundedPreceding, 0))
    closed = F.max(F.coalesce("closes_forced", F.lit(False))).over(path.rowsBetween(W.unboundedPreceding, -1))
    return (
        met.withColumn("_ended", ended | F.coalesce(closed, F.lit(False)))
        .filter(~F.col("_ended") & ~F.col("skipped"))
        .drop("_age", "_ended", "paid_last_week", "closes_forced", "skipped")
    )


def cohort_legs(live: DataFrame, *, book: Sequence[str]) -> DataFrame:
    """Leg weights of the union of live cohorts: each cohort on 1/H of capital, H being ``hold_weeks``.

    Shares divide by the size a cohort was formed with; what left stays cash.
    """
    share = F.lit(1.0) / F.col("hold_weeks") / F.col("formed_size") / 2
    legs = F.array(
        F.struct(F.col("spot_contract").alias("contract_id"), share.alias("w")),
        F.struct(F.col("perp_contract").alias("contract_id"), (-share).alias("w")),
    )
    return (
        live.withColumn("_leg", F.explode(legs))
        .groupBy(*book, "decision_ns", "_leg.contract_id")
        .agg(F.sum("_leg.w").alias("weight"))
    )


SLOT_SCHEMA = "fold_index long, member string, decision_ns long, pair_id string, entered_ns long, slot int"


def slot_book(
    ranked: DataFrame, calendar: DataFrame, tradeable: DataFrame, *, slots: int, hold_weeks: int,
    exit_on_negative: bool,
) -> DataFrame:
    """The slot book of each (fold, member): release, exit, refill in rank order.

    What is filled depends on what is held, so the weeks of one book run in
    sequence; books are independent and run in parallel. One book's input is
    its fold's weeks times the capped pair ranking.

    `ranked` has fold_index, member, decision_ns, pair_id, rank; `tradeable`
    has decision_ns, pair_id, ``closes_forced`` (a leg has no exit price) and
    ``paid_last_week`` for every pair with both bars at that decision.
    """
    weeks = calendar.filter(~F.col("is_warm_up")).select("fold_index", "decision_ns", "skipped")
    members = ranked.select("fold_index", "member").distinct()
    names = ranked.select("fold_index", "member", "pair_id").distinct()
    timeline = members.join(weeks, "fold_index").select(
        "fold_index", "member", "decision_ns", "skipped", F.lit(None).cast("string").alias("pair_id"),
        F.lit(None).cast("int").alias("rank"), F.lit(False).alias("closes_forced"),
        F.lit(False).alias("paid_last_week"), F.lit("week").alias("kind"),
    )
    offers = ranked.join(weeks, ["fold_index", "decision_ns"]).select(
        "fold_index", "member", "decision_ns", "skipped", "pair_id", "rank", F.lit(False).alias("closes_forced"),
        F.lit(False).alias("paid_last_week"), F.lit("offer").alias("kind"),
    )
    facts = names.join(weeks, "fold_index").join(tradeable, ["decision_ns", "pair_id"]).select(
        "fold_index", "member", "decision_ns", "skipped", "pair_id", F.lit(None).cast("int").alias("rank"),
        "closes_forced", "paid_last_week", F.lit("fact").alias("kind"),
    )

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        fold, member = frame["fold_index"].iloc[0], frame["member"].iloc[0]
        out: list[tuple] = []
        held: dict[str, int] = {}
        for decision, week in frame.sort_values("decision_ns").groupby("decision_ns", sort=True):
            if week["skipped"].iloc[0]:
                held = {}
                continue
            facts_now = week[week["kind"] == "fact"].set_index("pair_id")
            present = set(facts_now.index)
            paying = set(facts_now.index[facts_now["paid_last_week"]])
            held = {
                p: since for p, since in held.items()
                if decision - since < hold_weeks * WEEK_NS and p in present
                and (p in paying or not exit_on_negative)
            }
            offers_now = week[week["kind"] == "offer"].sort_values(["rank", "pair_id"])["pair_id"]
            for pair in offers_now:
                if len(held) >= slots:
                    break
                if pair not in held and (pair in paying or not exit_on_negative):
                    held[pair] = decision
            out += [(fold, member, decision, p, since, i) for i, (p, since) in enumerate(sorted(held.items()))]
            forced = set(facts_now.index[facts_now["closes_forced"]])
            held = {p: since for p, since in held.items() if p not in forced}
        return pd.DataFrame(
            out, columns=["fold_index", "member", "decision_ns", "pair_id", "entered_ns", "slot"]
        )

    return (
        timeline.unionByName(offers).unionByName(facts)
        .groupBy("fold_index", "member").applyInPandas(run, SLOT_SCHEMA)
    )
