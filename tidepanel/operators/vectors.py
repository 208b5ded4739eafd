"""Multi-week vector books: ageing cohorts and the per-leg exit rule."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.timefns import WEEK_NS


def cohort_book(
    vectors: DataFrame, calendar: DataFrame, members: dict[str, int], book: Sequence[str]
) -> DataFrame:
    """Sum of every retained vector over its hold; exact cancellations leave the book.

    `members` maps a member to its hold in weeks. Vectors explode to the
    decisions they may be held at, so ageing is an equi-join with the calendar.
    A vector formed before a skipped decision does not survive it: `era` numbers
    the stretches between skips, and forming and holding eras must agree.
    """
    hold = F.create_map(*[x for m, h in members.items() for x in (F.lit(m), F.lit(h))])
    weeks = F.coalesce(hold[F.col("member")], F.lit(1))
    live = calendar.filter(~F.col("is_warm_up") & ~F.col("skipped")).select("fold_index", "decision_ns", "era")
    return (
        vectors.withColumn("_hold", weeks)
        .withColumn("_age", F.explode(F.sequence(F.lit(0), F.col("_hold") - 1)))
        .withColumn("_formed_era", F.col("era")).drop("era")
        .withColumn("decision_ns", F.col("formed_ns") + F.col("_age") * F.lit(WEEK_NS))
        .join(live, ["fold_index", "decision_ns"])
        .filter(F.col("_formed_era") == F.col("era"))
        .groupBy(*book, "decision_ns", "contract_id")
        .agg(F.sum(F.col("weight") / F.col("_hold")).alias("weight"))
        .filter(F.abs("weight") > 1e-15)
    )


def sign_flip_book(
    vectors: DataFrame, calendar: DataFrame, paid: DataFrame, members: dict[str, int]
) -> DataFrame:
    """Cohort books under the sign-flip exit, per fold, member and contract.

    One flipped leg removes the contract from every retained vector, so what is
    removed depends on what earlier removals left: each contract's few weeks
    run in order, and contracts run in parallel. `paid` has contract_id,
    decision_ns and ``trailing_1w``.
    """
    weeks = calendar.filter(~F.col("skipped")).select("fold_index", "decision_ns", "is_warm_up", "era")
    names = vectors.select("fold_index", "member", "contract_id").distinct()
    grid = names.join(weeks, "fold_index").join(
        vectors.select("fold_index", "member", "contract_id", F.col("formed_ns").alias("decision_ns"), "weight"),
        ["fold_index", "member", "contract_id", "decision_ns"], "left",
    ).join(paid.select("contract_id", "decision_ns", "trailing_1w"), ["contract_id", "decision_ns"], "left")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        hold = members.get(first["member"], 1)
        held: list[tuple[int, float]] = []
        era, out = None, []
        for row in frame.sort_values("decision_ns").itertuples():
            if not row.is_warm_up and era is not None and row.era != era:
                held = []
            if not row.is_warm_up:
                era = row.era
            if pd.notna(row.weight):
                held.append((row.decision_ns, row.weight))
            held = [(f, w) for f, w in held if row.decision_ns - f < hold * WEEK_NS]
            if row.is_warm_up:
                continue
            rate = row.trailing_1w
            flipped = any(
                w != 0 and (pd.isna(rate) or (rate >= 0 if w > 0 else rate <= 0)) for _, w in held
            )
            if flipped:
                held = [(f, 0.0) for f, _ in held]
            total = sum(w for _, w in held) / hold
            if abs(total) > 1e-15:
                out.append((first["fold_index"], first["member"], row.decision_ns, first["contract_id"], total))
        return pd.DataFrame(out, columns=["fold_index", "member", "decision_ns", "contract_id", "weight"])

    return grid.groupBy("fold_index", "member", "contract_id").applyInPandas(
        run, "fold_index long, member string, decision_ns long, contract_id string, weight double"
    )
