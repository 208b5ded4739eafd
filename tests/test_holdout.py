"""The holdout job: what it may read, what it is judged by, and that it is read once."""

import pytest

from tidepanel.functions.timefns import DAY_NS, WEEK_NS
from tidepanel.operators.accounting import CostTable
from tidepanel.operators.walkforward import FoldGeometry
from tidepanel.plans import holdout

SMALL = FoldGeometry(train_ns=4 * WEEK_NS, validation_ns=2 * WEEK_NS, test_ns=2 * WEEK_NS, step_ns=2 * WEEK_NS, embargo_ns=WEEK_NS, holdout_ns=3 * WEEK_NS)
COSTS = (CostTable("base", 5.0, 2.0, 5.0), CostTable("adverse", 10.0, 2.0, 5.0))


def decisions(spark, weeks):
    return spark.createDataFrame([(w * WEEK_NS,) for w in range(weeks)], "decision_ns bigint")


def test_calendar_and_boundary(spark):
    calendar = holdout.holdout_calendar(decisions(spark, 20), SMALL, 7)
    assert sorted((r.decision_ns // WEEK_NS, r.priced, r.ordinal) for r in calendar.collect()) == [(17, True, 1), (18, True, 2), (19, False, 3)]
    boundary = calendar.select(holdout.read_boundary(calendar, 7).alias("b")).first().b
    assert boundary == 19 * WEEK_NS + 2
    bars = spark.createDataFrame([(18 * WEEK_NS,), (19 * WEEK_NS + DAY_NS,)], "close_time_ns bigint")
    assert [tuple(r) for r in holdout.exit_bars(bars, calendar, 7).collect()] == [(19 * WEEK_NS, False)]
    there = bars.unionByName(spark.createDataFrame([(19 * WEEK_NS,)], "close_time_ns bigint"))
    assert [tuple(r) for r in holdout.exit_bars(there, calendar, 7).collect()] == [(19 * WEEK_NS, True)]


def judge(spark, candidate, random=(0.0, 0.0), weights=(0.0,)):
    calendar = holdout.holdout_calendar(decisions(spark, 20), SMALL, 7)
    weeks = (17, 18)
    rows = [(w * WEEK_NS, m, s, net, 0) for m, nets in {"a": candidate, "no_trade": ((0.0, 0.0),) * 2, "random_ranks": (random,) * 2}.items()
            for w, pair in zip(weeks, nets, strict=True) for s, net in zip(("base", "adverse"), pair, strict=True)]
    episodes = spark.createDataFrame(rows, "decision_ns bigint, member string, scenario string, net_return double, forced_close_count bigint")
    lines = spark.createDataFrame(
        [(w * WEEK_NS, "a", s, f"c{i}", weight, 1, net / len(weights)) for w, pair in zip(weeks, candidate, strict=True)
         for s, net in zip(("base", "adverse"), pair, strict=True) for i, weight in enumerate(weights)],
        "decision_ns bigint, member string, scenario string, contract_id string, weight double, tier int, net double")
    return holdout.confirmation(episodes, lines, calendar, COSTS, ["a"]).first()


def test_every_gate_can_fail(spark):
    many = (0.25,) * 4
    good = judge(spark, ((0.1, 0.09), (0.11, 0.08)), weights=many)
    assert good.verdict == "holdout_failed" and not good.episode_share_within_limit  # two weeks: each is half of the total
    assert good.contract_share_within_limit and good.base_total_positive and good.adverse_after_exit_non_negative and good.skipped == 0
    assert good.exit_cost == pytest.approx(4 * 0.25 * (10.0 + 2.0) / 10_000)
    assert good.adverse_after_exit == pytest.approx(0.17 - good.exit_cost)
    poor = judge(spark, ((-0.1, -0.2), (0.05, 0.0)))
    assert not (poor.base_total_positive or poor.adverse_after_exit_non_negative or poor.base_dominates_no_trade or poor.base_dominates_random)
    assert poor.episode_share == 0.0 and poor.positive_week_fraction == 0.5
    beaten = judge(spark, ((0.1, 0.05), (0.1, 0.05)), random=(0.2, 0.2))
    assert not beaten.base_dominates_random and not beaten.adverse_dominates_random and not beaten.contract_share_within_limit
    assert not judge(spark, ((0.1, 0.0), (0.1, 0.0)), weights=(1.0,)).adverse_after_exit_non_negative


def test_a_declaration_is_read_once(spark, tmp_path):
    result = spark.createDataFrame([("a", 1)], "member string, episodes int")
    assert holdout.publish_once(result, str(tmp_path / "report")).collect() == result.collect()
    with pytest.raises(holdout.HoldoutRead):
        holdout.publish_once(result, str(tmp_path / "report"))
