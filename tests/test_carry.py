"""Members and controls of the carry job as rows of one ranking."""

from tidepanel.operators import carry
from tidepanel.operators.accounting import CostTable
from tidepanel.operators.universe import UniverseRules
from tidepanel.plans import families

RULES = families.CarryRules(carry.PairRules(UniverseRules(1, 1, 0.0, 10, 1, 2), 1, 9, 2), carry.Selection(1, 2))
COST = CostTable("base", 5.0, 2.0, 5.0, spot_fee_bps=10.0)
MEMBERS = (families.CarryMember("long", 4, 8), families.CarryMember("short", 2, 4, True), families.CarryMember("picky", 4, 4, False, 10.0))


def eligible(spark):
    sums = {"a": (0.5, 0.01), "b": (-0.1, 0.2), "c": (0.02, -0.3), "d": (None, 0.05)}
    rows = [(1, p, f"perp:{p}", f"spot:{p}", 1 + (p > "b"), *s) for p, s in sums.items()]
    return spark.createDataFrame(rows, "decision_ns bigint, pair_id string, perp_contract string, spot_contract string, tier int, trailing_4w double, trailing_2w double")


def pairs(rows, member):
    return [r.pair_id for r in sorted((r for r in rows if r.member == member), key=lambda r: r.rank)]


def test_members_rank_by_their_own_sums_and_hurdles(spark):
    rows = families.rank_members(eligible(spark), MEMBERS, RULES, COST).collect()
    assert pairs(rows, "long") == ["a", "c"] and pairs(rows, "short") == ["b", "d"]
    # 2 * 10 * (15 + 2 * 2) / 10,000 * 4 / 4 = 0.038 in tier one, 0.05 in tier two.
    assert pairs(rows, "picky") == ["a"]
    assert {(r.member, r.hold_weeks, r.exits) for r in rows} == {("long", 8, False), ("short", 4, True), ("picky", 4, False)}


def test_controls_borrow_the_first_of_the_shortest_holds(spark):
    assert families.control_reference(MEMBERS).name == "short"
    rows = families.rank_members(eligible(spark), MEMBERS, RULES, COST, controls=True).collect()
    assert pairs(rows, "all_pairs") == ["a", "b", "d"]  # those that paid over the reference's lookback
    drawn = pairs(rows, "random_pairs")
    assert len(drawn) == 2 and set(drawn) <= set("abcd")
    again = families.rank_members(eligible(spark).repartition(3), MEMBERS, RULES, COST, controls=True).collect()
    assert pairs(again, "random_pairs") == drawn
    assert {(r.hold_weeks, r.exits) for r in rows if r.member in carry.CONTROLS} == {(4, False)}
    assert families.carry_names(MEMBERS, True) == ["long", "short", "picky", "no_trade", "random_pairs", "all_pairs"]
