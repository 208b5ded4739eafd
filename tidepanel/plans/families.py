"""Weekly vector families over walk-forward folds, and the two-leg carry job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.operators import accounting, carry, funding, universe, vectors, walkforward, weights, windows
from tidepanel.plans.momentum import CONTROLS, PanelRules, control_weights
from tidepanel.session import staged

BOOK = ["fold_index", "member"]


@dataclass(frozen=True)
class TrendMember:
    name: str
    kind: str
    hold_weeks: int = 1
    threshold: float = 0.25


@dataclass(frozen=True)
class FundingMember:
    name: str
    lookback_weeks: int
    hold_weeks: int = 1
    sign_flip_exit: bool = False


@dataclass(frozen=True)
class CarryMember:
    name: str
    lookback_weeks: int
    hold_weeks: int
    exit_on_negative: bool = False
    hurdle_multiple: float | None = None


def fold_calendar(decisions: DataFrame, geometry: walkforward.FoldGeometry, warm_up: int) -> DataFrame:
    """Test decisions of every fold with their warm-up weeks; skips come later."""
    samples = walkforward.rebalance_samples(decisions, holding_days=7)
    members = walkforward.fold_membership(samples, walkforward.calendar_bounds(samples, geometry), geometry)
    return walkforward.with_warm_up(walkforward.test_calendar(members), warm_up)


def with_skips(calendar: DataFrame, live: DataFrame) -> DataFrame:
    """Mark decisions without a universe, and number the eras between in-window skips."""
    seen = live.select("decision_ns").distinct().withColumn("_live", F.lit(True))
    path = W.partitionBy("fold_index").orderBy("decision_ns").rowsBetween(W.unboundedPreceding, 0)
    marked = calendar.join(seen, "decision_ns", "left").withColumn("skipped", F.col("_live").isNull()).drop("_live")
    resets = (F.col("skipped") & ~F.col("is_warm_up")).cast("int")
    return marked.withColumn("era", F.sum(resets).over(path))


def in_folds(weekly: DataFrame, calendar: DataFrame) -> DataFrame:
    """Weekly vectors under each fold they form in, with ``formed_ns`` and era."""
    place = calendar.filter(~F.col("skipped")).select("fold_index", "decision_ns", "era")
    return weekly.join(place, "decision_ns").withColumnRenamed("decision_ns", "formed_ns")


def price_fold_books(
    book: DataFrame, bars: DataFrame, calendar: DataFrame, scenarios: Sequence[accounting.CostTable],
    names: Sequence[str], tiers: DataFrame, settlements: DataFrame | None, holding_days: int,
) -> DataFrame:
    """Episodes of assembled books; contracts without a bar at entry are dropped."""
    prices = windows.holding_prices(bars, holding_days).select(
        "contract_id", F.col("close_time_ns").alias("decision_ns"), "entry_close", "exit_close", "last_inside"
    )
    live = calendar.filter(~F.col("is_warm_up"))
    lines = accounting.evaluate_book(book, prices, live, scenarios, book=BOOK, tiers=tiers, settlements=settlements)
    return accounting.complete_grid(accounting.episodes(lines, BOOK), live, names, scenarios)


def trend_vectors(
    bars: DataFrame, eligible: DataFrame, rules: PanelRules, members: Sequence[TrendMember], spec: windows.IndicatorWindows
) -> DataFrame:
    """Weekly vectors of the trend members and controls."""
    features = windows.annualised_volatility(windows.trend_score(bars, "score", spec), rules.volatility_window_days)
    scored = eligible.join(
        features.select("contract_id", F.col("close_time_ns").alias("decision_ns"), "score", "volatility"),
        ["contract_id", "decision_ns"],
    ).filter(F.col("score").isNotNull())
    out = control_weights(eligible, rules)
    cross = [m.name for m in members if m.kind == "cross_sectional"]
    series = [m for m in members if m.kind == "time_series"]
    if cross:
        named = scored.withColumn("member", F.explode(F.array(*[F.lit(n) for n in cross])))
        out = out.unionByName(weights.quintile_weights(named, rules.weights))
    if series:
        options = F.array(*[F.struct(F.lit(m.name).alias("member"), F.lit(m.threshold).alias("t")) for m in series])
        named = scored.withColumn("_m", F.explode(options)).withColumn("member", F.col("_m.member")).withColumn(
            "sign", weights.dead_band_sign(F.col("score"), F.col("_m.t"))
        )
        out = out.unionByName(weights.inverse_volatility_weights(named, rules.weights))
    return out


def trend_fold(
    bars: DataFrame, decisions: DataFrame, rules: PanelRules, geometry: walkforward.FoldGeometry,
    members: Sequence[TrendMember], spec: windows.IndicatorWindows, scenarios: Sequence[accounting.CostTable],
) -> DataFrame:
    """The trend family over every fold: scores, cohorts, episodes."""
    bars = staged(bars, "bars")
    eligible = staged(universe.select_universe(bars, rules.universe), "universe")
    holds = {m.name: m.hold_weeks for m in members}
    calendar = staged(with_skips(fold_calendar(decisions, geometry, max(holds.values()) - 1), eligible), "calendar")
    formed = in_folds(trend_vectors(bars, eligible, rules, members, spec), calendar)
    book = vectors.cohort_book(formed, calendar, holds, BOOK)
    names = [*holds, *CONTROLS]
    return price_fold_books(book, bars, calendar, scenarios, names, eligible, None, rules.holding_days)


def funding_fold(
    bars: DataFrame, events: DataFrame, decisions: DataFrame, rules: PanelRules,
    geometry: walkforward.FoldGeometry, members: Sequence[FundingMember], scenarios: Sequence[accounting.CostTable],
) -> DataFrame:
    """The funding cross-section over every fold, with the sign-flip exit where declared."""
    bars = staged(bars, "bars")
    eligible = staged(universe.select_universe(bars, rules.universe), "universe")
    weekly = staged(funding.for_contracts(funding.weekly_settlements(events), bars), "settlements")
    holds = {m.name: m.hold_weeks for m in members}
    calendar = staged(with_skips(fold_calendar(decisions, geometry, max(holds.values()) - 1), eligible), "calendar")
    lookbacks = sorted({m.lookback_weeks for m in members})
    trailing = funding.trailing_weekly(weekly, eligible, lookbacks)
    options = F.array(*[
        F.struct(F.lit(m.name).alias("member"), F.col(f"trailing_{m.lookback_weeks}w").alias("score")) for m in members
    ])
    scored = trailing.withColumn("_m", F.explode(options)).select("decision_ns", "contract_id", "_m.*")
    formed = staged(in_folds(
        weights.quintile_weights(scored, rules.weights, reverse=True).unionByName(control_weights(eligible, rules)), calendar
    ), "vectors")
    flips = [m.name for m in members if m.sign_flip_exit]
    plain = vectors.cohort_book(formed.filter(~F.col("member").isin(*flips)), calendar, holds, BOOK)
    if flips:
        flipped = formed.filter(F.col("member").isin(*flips))
        paid = weekly.select("contract_id", "decision_ns", F.col("settled").cast("double").alias("trailing_1w"))
        plain = plain.unionByName(vectors.sign_flip_book(flipped, calendar, paid, holds))
    names = [*holds, *CONTROLS]
    return price_fold_books(plain, bars, calendar, scenarios, names, eligible, weekly, rules.holding_days)


def pair_facts(legs: DataFrame, pairs: DataFrame, weekly: DataFrame, holding_days: int) -> DataFrame:
    """Per pair and decision with both bars: last week's payment, forced close ahead."""
    prices = windows.holding_prices(legs, holding_days).select(
        "contract_id", F.col("close_time_ns").alias("decision_ns"), F.col("exit_close").isNull().alias("_forced")
    )
    named = pairs.select("pair_id", "perp_contract", "spot_contract").distinct()
    leg = lambda c, f: prices.select(F.col("contract_id").alias(c), "decision_ns", F.col("_forced").alias(f))
    paid = weekly.select(F.col("contract_id").alias("perp_contract"), "decision_ns", F.col("settled").cast("double").alias("trailing_1w"))
    return (
        named.join(leg("perp_contract", "_f1"), "perp_contract")
        .join(leg("spot_contract", "_f2"), ["spot_contract", "decision_ns"])
        .join(paid, ["perp_contract", "decision_ns"], "left")
        .select(
            "pair_id", "decision_ns", (F.col("_f1") | F.col("_f2")).alias("closes_forced"),
            F.coalesce(F.col("trailing_1w") > 0, F.lit(False)).alias("paid_last_week"),
        )
    )


@dataclass(frozen=True)
class CarryRules:
    pairs: carry.PairRules
    selection: carry.Selection
    holding_days: int = 7
    random_seed: int = 17
    slots: int | None = None  # a slot book instead of weekly cohorts


def control_reference(members: Sequence[CarryMember]) -> CarryMember:
    """The member whose lookback and hold the controls borrow: the shortest hold, the first declared among equals."""
    return min(members, key=lambda m: m.hold_weeks)


def member_rows(eligible: DataFrame, members: Sequence[CarryMember]) -> DataFrame:
    """`eligible` once for each member, with the member's parameters and its ``trailing`` sum."""
    options = F.array(*[
        F.struct(
            F.lit(m.name).alias("member"), F.col(f"trailing_{m.lookback_weeks}w").alias("trailing"), F.lit(m.lookback_weeks).alias("lookback_weeks"),
            F.lit(m.hold_weeks).alias("hold_weeks"), F.lit(m.exit_on_negative).alias("exits"), F.lit(m.hurdle_multiple).cast("double").alias("multiple"),
        ) for m in members
    ])
    return eligible.withColumn("_m", F.explode(options)).select(*eligible.columns, "_m.*")


RANKED = ("decision_ns", "member", "pair_id", "perp_contract", "spot_contract", "tier", "rank", "trailing", "hold_weeks", "exits")


def rank_members(
    eligible: DataFrame, members: Sequence[CarryMember], rules: CarryRules, cost: accounting.CostTable, *, controls: bool = False,
) -> DataFrame:
    """The paying ranking of every member per decision, in one plan; `eligible` has trailing_<n>w. Controls are members too."""
    floor = carry.hurdle(
        cost, F.col("tier"), multiple=F.col("multiple"), lookback_weeks=F.col("lookback_weeks"), hold_weeks=F.col("hold_weeks")
    )
    ranked = carry.rank_paying(member_rows(eligible, members), rules.selection, minimum=floor, group=("member", "decision_ns")).select(*RANKED)
    if not controls:
        return ranked
    reference = control_reference(members)
    borrowed = eligible.withColumns({
        "trailing": F.col(f"trailing_{reference.lookback_weeks}w"), "hold_weeks": F.lit(reference.hold_weeks), "exits": F.lit(False),
    })
    return ranked.unionByName(carry.control_pairs(borrowed, rules.selection, rules.random_seed).select(*RANKED))


@dataclass(frozen=True)
class CarryInputs:
    """Staged tables one carry job reads several times."""

    legs: DataFrame
    eligible: DataFrame
    weekly: DataFrame
    calendar: DataFrame
    facts: DataFrame


def carry_inputs(
    legs: DataFrame, pairs: DataFrame, events: DataFrame, decisions: DataFrame, rules: CarryRules,
    geometry: walkforward.FoldGeometry, members: Sequence[CarryMember],
) -> CarryInputs:
    legs = staged(legs, "legs")
    chosen = staged(carry.select_pairs(legs, pairs, rules.pairs), "pairs")
    perps = legs.filter(carry.leg_market(F.col("contract_id")) == "perp")
    weekly = staged(funding.for_contracts(funding.weekly_settlements(events), perps), "settlements")
    lookbacks = sorted({m.lookback_weeks for m in members})
    asked = chosen.select("decision_ns", F.col("perp_contract").alias("contract_id"))
    sums = funding.trailing_weekly(weekly, asked, lookbacks).withColumnRenamed("contract_id", "perp_contract")
    eligible = staged(chosen.join(sums, ["decision_ns", "perp_contract"]), "eligible")
    # Slot books never warm up: they start empty and fill from the first decision.
    warm_up = 0 if rules.slots else max(m.hold_weeks for m in members) - 1
    calendar = staged(with_skips(fold_calendar(decisions, geometry, warm_up), eligible), "calendar")
    facts = staged(pair_facts(legs, eligible, weekly, rules.holding_days), "facts")
    return CarryInputs(legs, eligible, weekly, calendar, facts)


def carry_entries(inputs: CarryInputs, members: Sequence[CarryMember], rules: CarryRules, cost: accounting.CostTable, *, controls: bool = False) -> DataFrame:
    """What every member's cohorts are formed of, with the size they are formed with."""
    place = inputs.calendar.filter(~F.col("skipped")).select("fold_index", "decision_ns")
    ranked = rank_members(inputs.eligible, members, rules, cost, controls=controls).join(place, "decision_ns")
    size = F.count("*").over(W.partitionBy("fold_index", "member", "decision_ns"))
    return ranked.withColumn("formed_size", size).withColumnRenamed("decision_ns", "formed_ns")


def carry_legs(
    inputs: CarryInputs, members: Sequence[CarryMember], rules: CarryRules, cost: accounting.CostTable, *, controls: bool = False,
) -> DataFrame:
    """Leg weights of every member's book at every live decision of every fold."""
    if not rules.slots:
        entries = carry_entries(inputs, members, rules, cost, controls=controls)
        return carry.cohort_legs(carry.live_cohorts(entries, inputs.calendar, inputs.facts, book=BOOK), book=BOOK)
    place = inputs.calendar.filter(~F.col("skipped")).select("fold_index", "decision_ns")
    placed = staged(rank_members(inputs.eligible, members, rules, cost).join(place, "decision_ns"), "ranked")
    named = inputs.eligible.select("pair_id", "perp_contract", "spot_contract").distinct()
    out = None
    for m in members:
        book = carry.slot_book(
            placed.filter(F.col("member") == m.name), inputs.calendar, inputs.facts, slots=rules.slots, hold_weeks=m.hold_weeks,
            exit_on_negative=m.exit_on_negative,
        )
        held = book.join(named, "pair_id").withColumns({"formed_size": F.lit(1), "hold_weeks": F.lit(rules.slots)})
        legs = carry.cohort_legs(held, book=BOOK)
        out = legs if out is None else out.unionByName(legs)
    return out


def leg_tiers(inputs: CarryInputs) -> DataFrame:
    return inputs.eligible.select("decision_ns", "tier", F.explode(F.array("perp_contract", "spot_contract")).alias("contract_id"))


def carry_names(members: Sequence[CarryMember], controls: bool) -> list[str]:
    return [m.name for m in members] + list(carry.CONTROLS if controls else ())


def carry_lines(
    inputs: CarryInputs, members: Sequence[CarryMember], rules: CarryRules, scenarios: Sequence[accounting.CostTable], *, controls: bool = False,
) -> DataFrame:
    """Leg-level lines of every book: a pair's two legs are contracts of their own."""
    legs = carry_legs(inputs, members, rules, scenarios[0], controls=controls)
    prices = windows.holding_prices(inputs.legs, rules.holding_days).select(
        "contract_id", F.col("close_time_ns").alias("decision_ns"), "entry_close", "exit_close", "last_inside"
    )
    live = inputs.calendar.filter(~F.col("is_warm_up"))
    return accounting.evaluate_book(legs, prices, live, scenarios, book=BOOK, tiers=leg_tiers(inputs), settlements=inputs.weekly)


def carry_episodes(
    lines: DataFrame, inputs: CarryInputs, scenarios: Sequence[accounting.CostTable], names: Sequence[str],
) -> DataFrame:
    live = inputs.calendar.filter(~F.col("is_warm_up"))
    return accounting.complete_grid(accounting.episodes(lines, BOOK), live, names, scenarios)


def carry_fold(
    inputs: CarryInputs, members: Sequence[CarryMember], rules: CarryRules, scenarios: Sequence[accounting.CostTable]
) -> DataFrame:
    """Carry episodes: two-leg books priced leg by leg under every scenario."""
    lines = carry_lines(inputs, members, rules, scenarios)
    return carry_episodes(lines, inputs, scenarios, carry_names(members, controls=False))


def leg_split(lines: DataFrame) -> DataFrame:
    """Each episode's turnover cost, funding and forced closes by market of the leg."""
    market = carry.leg_market(F.col("contract_id"))
    forced = F.col("forced") & (F.col("weight") != 0)
    return lines.groupBy(*BOOK, "decision_ns", "scenario").agg(
        F.sum(F.when(market == "spot", F.col("turnover_cost")).otherwise(0.0)).alias("spot_cost"),
        F.sum(F.when(market == "perp", F.col("turnover_cost")).otherwise(0.0)).alias("perp_cost"),
        F.count_if(forced & (market == "spot")).alias("forced_spot_legs"), F.count_if(forced & (market == "perp")).alias("forced_perp_legs"),
        (-F.sum("funding_cost")).alias("funding_collected"), F.sum("gross").alias("basis_pnl"),
    )


def pair_contributions(lines: DataFrame, eligible: DataFrame) -> DataFrame:
    """What each pair contributed to each episode: its legs' net, summed under the pair."""
    named = eligible.select("pair_id", F.explode(F.array("perp_contract", "spot_contract")).alias("contract_id")).distinct()
    return lines.join(named, "contract_id").groupBy(*BOOK, "decision_ns", "scenario", "pair_id").agg(F.sum("net").alias("net"))
