"""The holdout: one derived candidate, read once on the decisions that no fold has seen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions.timefns import DAY_NS
from tidepanel.operators import accounting, walkforward
from tidepanel.plans import momentum

# The limits a confirmation is judged by.
CONCENTRATION_LIMIT = 0.4
SKIP_LIMIT = 4


def holdout_calendar(decisions: DataFrame, geometry: walkforward.FoldGeometry, holding_days: int) -> DataFrame:
    """Decisions after the last fold, in order; `priced` says whether the exit falls inside the panel's calendar."""
    samples = walkforward.rebalance_samples(decisions, holding_days=holding_days)
    kept = walkforward.holdout_samples(samples, walkforward.calendar_bounds(samples, geometry))
    last = samples.select(F.max("decision_ns")).scalar()
    # A holdout is a few dozen weeks, so one ordered window over them is small.
    return kept.select("decision_ns", (F.col("label_end_ns") <= last).alias("priced")).withColumn(
        "ordinal", F.row_number().over(W.orderBy("decision_ns")).cast("long")
    )


def read_boundary(calendar: DataFrame, holding_days: int) -> Column:
    """What may be read: bars available before the last exit close plus two nanoseconds.

    A bar is available one nanosecond after its close, so the last exit is the
    latest bar inside and the day after it is out.
    """
    last = calendar.filter("priced").select(F.max("decision_ns")).scalar()
    return last + F.lit(holding_days * DAY_NS + 2)


def final_exit_cost(lines: DataFrame, scenarios: Sequence[accounting.CostTable]) -> DataFrame:
    """(member, scenario, exit_cost): leaving the book of the last decision, which no episode is charged for."""
    last = lines.select(F.max("decision_ns")).scalar()
    held = lines.filter((F.col("decision_ns") == last) & (F.col("weight") != 0))
    cost = F.filter(accounting.scenario_column(scenarios), lambda c: c["scenario"] == F.col("scenario"))
    priced = held.withColumn("cost", F.element_at(cost, 1))
    paid = F.abs("weight") * accounting.per_side_bps() / F.lit(accounting.BPS)
    return priced.groupBy("member", "scenario").agg(F.sum(paid).alias("exit_cost"))


def evaluate(
    bars: DataFrame, events: DataFrame, calendar: DataFrame, rules: momentum.PanelRules,
    members: Sequence[momentum.MomentumMember], scenarios: Sequence[accounting.CostTable],
) -> tuple[DataFrame, DataFrame]:
    """Episodes and lines of the priced holdout decisions, from bars within the boundary only."""
    known = bars.filter(F.col("available_time_ns") < read_boundary(calendar, rules.holding_days))
    live = calendar.filter("priced").select("decision_ns", "ordinal")
    return momentum.momentum_episodes(known, live, rules, members, scenarios, events)


def exit_bars(bars: DataFrame, calendar: DataFrame, holding_days: int) -> DataFrame:
    """One row: whether any contract has a bar at the last exit close; without one the holdout must not be opened."""
    close = read_boundary(calendar, holding_days) - F.lit(2)
    return bars.select("close_time_ns").withColumn("_exit", close).agg(
        F.max("_exit").alias("exit_close_ns"), F.coalesce(F.max(F.col("close_time_ns") == F.col("_exit")), F.lit(False)).alias("exit_priced")
    )


def confirmation(
    rows: DataFrame, lines: DataFrame, calendar: DataFrame, scenarios: Sequence[accounting.CostTable], names: Sequence[str],
) -> DataFrame:
    """The eight gates of each named member, and what is told beside them, from holdout rows alone."""
    base = F.col("scenario") == "base"
    totals = rows.groupBy("member").agg(
        F.sum(F.when(base, F.col("net_return"))).alias("base_total"),
        F.sum(F.when(~base, F.col("net_return"))).alias("adverse_total"),
        F.count_if(base).alias("episodes"),
        F.max(F.when(base, F.col("net_return"))).alias("_episode"),
        F.count_if(base & (F.col("net_return") > 0)).alias("_won"),
        F.sum(F.when(base, F.col("forced_close_count"))).alias("forced_closes"),
    )
    by_contract = lines.filter(base).groupBy("member", "contract_id").agg(F.sum("net").alias("_net")).groupBy("member").agg(
        F.max("_net").alias("_contract")
    )
    exits = final_exit_cost(lines, scenarios).filter(~base).select("member", "exit_cost")
    of = lambda member, column: totals.filter(F.col("member") == member).select(column).scalar()
    live = rows.select("decision_ns").distinct()
    skipped = calendar.filter("priced").join(live, "decision_ns", "left_anti").select(F.count("*")).scalar()
    share = lambda c: F.when(F.col("base_total") > 0, F.coalesce(c, F.lit(0.0)) / F.col("base_total")).otherwise(0.0)
    judged = totals.filter(F.col("member").isin(*names)).join(by_contract, "member", "left").join(exits, "member", "left").withColumns({
        "exit_cost": F.coalesce("exit_cost", F.lit(0.0)), "skipped": skipped,
        "episode_share": share(F.col("_episode")), "contract_share": share(F.col("_contract")),
    }).withColumn("adverse_after_exit", F.col("adverse_total") - F.col("exit_cost"))
    gates = {
        "base_total_positive": F.col("base_total") > 0,
        "adverse_after_exit_non_negative": F.col("adverse_after_exit") >= 0,
        "base_dominates_no_trade": F.col("base_total") > of("no_trade", "base_total"),
        "base_dominates_random": F.col("base_total") > of("random_ranks", "base_total"),
        "adverse_dominates_random": F.col("adverse_after_exit") >= of("random_ranks", "adverse_total"),
        "episode_share_within_limit": F.col("episode_share") <= CONCENTRATION_LIMIT,
        "contract_share_within_limit": F.col("contract_share") <= CONCENTRATION_LIMIT,
        "skipped_within_limit": F.col("skipped") <= SKIP_LIMIT,
    }
    every = F.lit(True)
    for name in gates:
        every = every & F.col(name)
    return judged.withColumns(gates).select(
        "member", "episodes", "skipped", "base_total", "adverse_total", "exit_cost", "adverse_after_exit", "episode_share", "contract_share",
        *gates, F.when(every, "holdout_confirmed").otherwise("holdout_failed").alias("verdict"),
        (F.col("base_total") / F.col("episodes")).alias("base_mean"), (F.col("_won") / F.col("episodes")).alias("positive_week_fraction"),
        "forced_closes",
    )


class HoldoutRead(Exception):
    """The declaration's one read has been spent."""


def publish_once(result: DataFrame, path: str) -> DataFrame:
    """Write the report of a declaration under its path, once for ever, and read it back."""
    try:
        result.write.mode("errorifexists").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        raise HoldoutRead(f"this declaration's holdout has already been read: {path}") from error
    return result.sparkSession.read.schema(result.schema).parquet(path)
