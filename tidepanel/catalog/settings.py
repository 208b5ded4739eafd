"""Parameters the registered queries run with, shared with their SQL."""

from __future__ import annotations

from tidepanel.functions.timefns import DAY_NS, HOUR_NS
from tidepanel.operators.accounting import CostTable
from tidepanel.operators.stats import SignalCost
from tidepanel.operators.universe import UniverseRules
from tidepanel.operators.walkforward import FoldGeometry
from tidepanel.operators.weights import WeightRules
from tidepanel.operators.windows import IndicatorWindows
from tidepanel.plans.momentum import MomentumMember, PanelRules

UNIVERSE = UniverseRules(
    minimum_history_days=30, liquidity_window_days=5, minimum_median_quote_volume=0.0,
    maximum_contracts=5, minimum_contracts=2, tier_one_rank_limit=2,
)
WEIGHTS = WeightRules(minimum_quintile_size=1, leg_gross=0.5, volatility_floor=0.1)
PANEL = PanelRules(UNIVERSE, WEIGHTS, volatility_window_days=5)
BASE = CostTable("base", 5.0, 2.0, 5.0)
ADVERSE = CostTable("adverse", 5.0, 6.0, 15.0, 0.5, 1.5, 2.0)
SCENARIOS = (BASE, ADVERSE)
MEMBERS = (
    MomentumMember("xs_7d", "cross_sectional", 7),
    MomentumMember("xs_28d_rev", "cross_sectional", 28, reverse=True),
    MomentumMember("ts_7d", "time_series", 7),
    MomentumMember("ts_28d", "time_series", 28),
)
GEOMETRY = FoldGeometry()
# The declared indicator windows span 121 days; these fit a gappy panel too.
SHORT_INDICATORS = IndicatorWindows(
    sma=(2, 3, 5), crosses=((2, 3), (3, 5)), breakout=(2, 3, 5), roc=(1, 3, 6), macd=(3, 6)
)
INDICATORS = IndicatorWindows()
BRAND_UNIVERSE = UniverseRules(
    minimum_history_days=30, liquidity_window_days=2, minimum_median_quote_volume=20_000.0,
    maximum_contracts=8, minimum_contracts=3, tier_one_rank_limit=3,
)
SIGNAL_COSTS = (SignalCost("base", 5.0, 1.0, 2.0, 0.5), SignalCost("adverse", 8.0, 2.0, 6.0, 1.0))
BAR_GEOMETRY = FoldGeometry(
    train_ns=8 * DAY_NS, validation_ns=3 * DAY_NS, test_ns=3 * DAY_NS, step_ns=3 * DAY_NS,
    embargo_ns=6 * HOUR_NS, holdout_ns=3 * DAY_NS,
)
CARRY_BASE = CostTable("base", 5.0, 2.0, 5.0, spot_fee_bps=10.0)
CARRY_ADVERSE = CostTable("adverse", 5.0, 6.0, 15.0, 0.5, 1.5, 2.0, spot_fee_bps=10.0)
