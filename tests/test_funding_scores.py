"""Funding scores at a decision: who was scored, who was not, and their mean."""

import pytest
from pyspark.sql import functions as F

from tidepanel.functions.timefns import WEEK_NS
from tidepanel.operators import funding


def test_unscored_contracts_are_counted_and_not_averaged(spark):
    weekly = spark.createDataFrame([("a", 1, 0.2), ("a", 2, 0.4), ("b", 1, -0.6), ("z", 2, 9.0)], "contract_id string, week long, settled double").select(
        "contract_id", (F.col("week") * F.lit(WEEK_NS)).alias("decision_ns"), "settled")
    eligible = spark.createDataFrame([("a", 2), ("b", 2), ("c", 2), ("c", 3)], "contract_id string, week long").select(
        "contract_id", (F.col("week") * F.lit(WEEK_NS)).alias("decision_ns"))
    got = {(r.decision_ns // WEEK_NS, r.lookback_weeks): (r.scored, r.unscored, pytest.approx(r.mean_score))
           for r in funding.score_extras(weekly, eligible, [1, 2]).collect()}
    # One week: only a; two weeks: a and b. A contract outside the universe counts nowhere.
    assert got == {(2, 1): (1, 2, 0.4), (2, 2): (2, 1, 0.0), (3, 1): (0, 1, 0.0), (3, 2): (0, 1, 0.0)}
