"""Episode accounting: what a weekly book earned, and what turning it over cost."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions.timefns import WEEK_NS

BPS = 10_000.0


@dataclass(frozen=True)
class CostTable:
    """One cost scenario; `spot_fee_bps` overrides the fee of spot legs."""

    scenario: str
    fee_bps: float
    slippage_tier1_bps: float
    slippage_tier2_bps: float
    receipt_multiplier: float = 1.0
    payment_multiplier: float = 1.0
    forced_multiplier: float = 1.0
    spot_fee_bps: float | None = None


def scenario_column(scenarios: Sequence[CostTable]) -> Column:
    """The scenarios as a literal array, so crossing rows with them is no join."""
    types = {f.name: "string" if f.name == "scenario" else "double" for f in fields(CostTable)}
    return F.array(
        *[
            F.struct(*[F.lit(v).cast(types[k]).alias(k) for k, v in asdict(s).items()])
            for s in scenarios
        ]
    )


def per_side_bps(cost: str = "cost", tier: str = "tier", contract: str = "contract_id") -> Column:
    """Fee plus tiered slippage of one side; an unknown tier pays tier two."""
    fee = F.when(
        F.col(contract).startswith("spot:") & F.col(f"{cost}.spot_fee_bps").isNotNull(),
        F.col(f"{cost}.spot_fee_bps"),
    ).otherwise(F.col(f"{cost}.fee_bps"))
    slippage = F.when(
        F.coalesce(F.col(tier), F.lit(2)) == 1, F.col(f"{cost}.slippage_tier1_bps")
    ).otherwise(F.col(f"{cost}.slippage_tier2_bps"))
    return fee + slippage


def held_positions(weights: DataFrame, prices: DataFrame, book: Sequence[str]) -> DataFrame:
    """Weights with their holding-period return, forced-close flag and drift.

    A missing exit closes the position at the last price inside the period, or
    flat at entry. Drift is what the target weight grew into by the exit.
    """
    cell = W.partitionBy(*book, "decision_ns")
    exit_price = F.coalesce("exit_close", "last_inside", "entry_close")
    gross = F.sum(F.col("weight") * F.col("return")).over(cell)
    return (
        weights.join(prices, ["contract_id", "decision_ns"])
        .withColumn("return", exit_price / F.col("entry_close") - 1)
        .withColumn("forced", F.col("exit_close").isNull())
        .withColumn("_growth", 1 + gross)
        .withColumn(
            "drift",
            F.when(F.col("forced") | (F.col("_growth") == 0), F.lit(0.0)).otherwise(
                F.col("weight") * (1 + F.col("return")) / F.col("_growth")
            ),
        )
        .drop("entry_close", "exit_close", "last_inside", "_growth")
    )


def with_previous(held: DataFrame, calendar: DataFrame, book: Sequence[str]) -> DataFrame:
    """Pair each position with the drift carried into it; add pure exits.

    Targets never read drift, so the carried book is a lag over decision
    ordinals rather than a recursion. A position not renewed at the following
    decision becomes an exit row there, unless that decision is skipped.
    """
    following = calendar.filter(~F.col("skipped")).select(
        *[c for c in ("fold_index",) if c in calendar.columns],
        (F.col("ordinal") - 1).alias("ordinal"),
        F.col("decision_ns").alias("_next_ns"),
    )
    on = [c for c in ("fold_index",) if c in calendar.columns]
    placed = held.join(
        calendar.select(*on, "decision_ns", "ordinal"), [*on, "decision_ns"]
    ).join(following, [*on, "ordinal"], "left")
    w = W.partitionBy(*book, "contract_id").orderBy("ordinal")
    adjacent = F.lag("ordinal").over(w) == F.col("ordinal") - 1
    renewed = F.lead("ordinal").over(w) == F.col("ordinal") + 1
    current = F.struct(
        F.col("decision_ns").alias("decision_ns"), F.col("weight").alias("weight"),
        F.col("_previous").alias("previous"), F.col("return").alias("return"),
        F.col("forced").alias("forced"),
    )
    leaving = F.struct(
        F.col("_next_ns").alias("decision_ns"), F.lit(0.0).alias("weight"),
        F.col("drift").alias("previous"), F.lit(0.0).alias("return"), F.lit(False).alias("forced"),
    )
    return (
        placed.withColumn("_previous", F.when(adjacent, F.lag("drift").over(w)).otherwise(0.0))
        .withColumn("_previous", F.coalesce("_previous", F.lit(0.0)))
        .withColumn("_leaves", ~F.coalesce(renewed, F.lit(False)) & F.col("_next_ns").isNotNull())
        .withColumn(
            "_line", F.explode(F.when(F.col("_leaves"), F.array(current, leaving)).otherwise(F.array(current)))
        )
        .select(*book, "contract_id", "_line.*")
    )


def price_lines(
    lines: DataFrame, scenarios: Sequence[CostTable], *, tiers: DataFrame | None = None,
    settlements: DataFrame | None = None,
) -> DataFrame:
    """Each contract's contribution to an episode under every cost scenario.

    `settlements` are weekly totals stamped with the decision that ends their
    week, so a position entered at t pays the row stamped one week later.
    """
    rows = lines
    if tiers is not None:
        rows = rows.join(tiers.select("decision_ns", "contract_id", "tier"), ["decision_ns", "contract_id"], "left")
    else:
        rows = rows.withColumn("tier", F.lit(None).cast("int"))
    if settlements is not None:
        paid = settlements.select(
            "contract_id",
            (F.col("decision_ns") - F.lit(WEEK_NS)).alias("decision_ns"),
            F.col("positive").cast("double").alias("_pos"),
            F.col("negative").cast("double").alias("_neg"),
        )
        rows = rows.join(paid, ["contract_id", "decision_ns"], "left").fillna(0.0, ["_pos", "_neg"])
    else:
        rows = rows.withColumns({"_pos": F.lit(0.0), "_neg": F.lit(0.0)})
    change = F.abs(F.col("weight") - F.col("previous"))
    owed = F.when(F.col("weight") > 0, F.col("_pos")).otherwise(F.col("_neg"))
    earned = F.when(F.col("weight") > 0, F.col("_neg")).otherwise(F.col("_pos"))
    side = per_side_bps() / F.lit(BPS)
    return (
        rows.withColumn("cost", F.explode(scenario_column(scenarios)))
        .withColumns(
            {
                "scenario": F.col("cost.scenario"),
                "gross": F.col("weight") * F.col("return"),
                "turnover": change,
                "turnover_cost": change * side,
                "funding_cost": F.col("weight")
                * (owed * F.col("cost.payment_multiplier") + earned * F.col("cost.receipt_multiplier")),
                "forced_close_cost": F.when(
                    F.col("forced"), F.abs("weight") * side * F.col("cost.forced_multiplier")
                ).otherwise(0.0),
            }
        )
        .withColumn(
            "net",
            F.col("gross") - F.col("turnover_cost") - F.col("funding_cost") - F.col("forced_close_cost"),
        )
        .drop("cost", "_pos", "_neg")
    )


def episodes(lines: DataFrame, book: Sequence[str]) -> DataFrame:
    """Contract lines summed to one row per decision, member and scenario."""
    total = lambda c: F.sum(c)
    return lines.groupBy(*book, "decision_ns", "scenario").agg(
        total("gross").alias("gross_return"),
        total("turnover").alias("turnover"),
        total("turnover_cost").alias("turnover_cost"),
        total("funding_cost").alias("funding_cost"),
        total("forced_close_cost").alias("forced_close_cost"),
        total("net").alias("net_return"),
        total(F.abs("weight")).alias("gross_exposure"),
        total("weight").alias("net_exposure"),
        F.count_if("forced").alias("forced_close_count"),
        F.count_if(F.col("weight") != 0).alias("positions"),
    )


def complete_grid(
    episodes_df: DataFrame, calendar: DataFrame, members: Sequence[str],
    scenarios: Sequence[CostTable],
) -> DataFrame:
    """Every member and scenario gets a row at every decision that is not skipped."""
    on = [c for c in ("fold_index",) if c in calendar.columns]
    grid = (
        calendar.filter(~F.col("skipped"))
        .select(*on, "decision_ns", "ordinal")
        .withColumn("member", F.explode(F.array(*[F.lit(m) for m in members])))
        .withColumn("scenario", F.explode(F.array(*[F.lit(s.scenario) for s in scenarios])))
    )
    filled = grid.join(episodes_df, [*on, "decision_ns", "member", "scenario"], "left")
    amounts = [
        "gross_return", "turnover", "turnover_cost", "funding_cost", "forced_close_cost",
        "net_return", "gross_exposure", "net_exposure",
    ]
    return filled.fillna(0.0, amounts).fillna(0, ["forced_close_count", "positions"])


def evaluate_book(
    weights: DataFrame, prices: DataFrame, calendar: DataFrame, scenarios: Sequence[CostTable], *,
    book: Sequence[str] = ("member",), tiers: DataFrame | None = None,
    settlements: DataFrame | None = None,
) -> DataFrame:
    """Contract-level lines of every episode of every book; see `episodes`."""
    held = held_positions(weights, prices, book)
    return price_lines(
        with_previous(held, calendar, book), scenarios, tiers=tiers, settlements=settlements
    )
