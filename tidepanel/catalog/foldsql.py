"""DuckDB SQL of the model fits, over a CTE `members` of samples by fold and partition.

Every builder returns CTEs to add to a query; `recursive` marks the finished
text, since gradient steps are written as recursive CTEs.
"""

from __future__ import annotations

from tidepanel.operators.foldmodels import GAIN_DIGITS
from tidepanel.operators.models import FEATURES

SIZE = len(FEATURES)
ALL = range(SIZE)
X = ("observed_return", "range_bps", "coalesce(volume_change, 0)", "coalesce(cross_basis, 0)")
INPUTS = ", ".join(f"CAST({x} AS DOUBLE) AS x{i}" for i, x in enumerate(X))
COLUMNS = f"sample_id, instrument_id, decision_ns, CAST(forward_return AS DOUBLE) AS y, {INPUTS}"
SIGMOID = "CASE WHEN {0} >= 0 THEN 1 / (1 + exp(-({0}))) ELSE exp({0}) / (1 + exp({0})) END"


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def fold_members(partitions=("train", "validation", "test")) -> dict[str, str]:
    """`members` of every fold, purged by label, from `samples` and `folds`."""
    return {"members": " UNION ALL ".join(
        f"SELECT fold_index, '{p}' AS part, {COLUMNS} FROM samples JOIN folds ON decision_ns >= {p}_start_ns AND decision_ns < {p}_end_ns "
        f"AND label_available_ns < {p}_end_ns" for p in partitions)}


def single_members() -> dict[str, str]:
    """`members` of one cut in time at 60% and 80%, as fold 0."""
    return {"members": f"""
    SELECT 0 AS fold_index, CASE WHEN "position" < 0.6::DOUBLE THEN 'train' WHEN "position" < 0.8::DOUBLE THEN 'validation' ELSE 'test' END AS part, {COLUMNS}
    FROM (SELECT *, (decision_ns - min(decision_ns) OVER ())::DOUBLE / (max(decision_ns) OVER () - min(decision_ns) OVER ())::DOUBLE AS "position" FROM samples)"""}


def scaling() -> dict[str, str]:
    stats = ", ".join(f"avg(x{i}) AS m{i}, CASE WHEN stddev_pop(x{i}) > 0 THEN stddev_pop(x{i}) ELSE 1 END AS s{i}" for i in ALL)
    scaled = ", ".join(f"(x{i} - m{i}) / s{i} AS z{i}" for i in ALL)
    return {
        "scales": f"SELECT fold_index, count(*) AS train_samples, avg(y) AS ym, {stats} FROM members WHERE part = 'train' GROUP BY ALL",
        "scaled": f"SELECT v.*, {scaled} FROM members v JOIN scales USING (fold_index)",
    }


def ridge(alpha: float) -> dict[str, str]:
    """`ridge(fold_index, b0.., a)`: the normal equations, one elimination step a CTE."""
    cells = [f"sum(z{i} * z{j}){f' + {alpha}::DOUBLE' if i == j else ''} AS c{i}{j}" for i in ALL for j in ALL]
    cells += [f"sum(z{i} * (y - ym)) AS c{i}{SIZE}" for i in ALL]
    out = {"elim0": f"SELECT fold_index, {', '.join(cells)} FROM scaled JOIN scales USING (fold_index) WHERE part = 'train' GROUP BY ALL"}
    for k in ALL:
        step = [f"c{k}{j} / c{k}{k} AS c{k}{j}" if i == k else f"c{i}{j} - c{i}{k} * c{k}{j} / c{k}{k} AS c{i}{j}"
                for i in ALL for j in range(SIZE + 1)]
        out[f"elim{k + 1}"] = f"SELECT fold_index, {', '.join(step)} FROM elim{k}"
    out["ridge"] = f"SELECT fold_index, {', '.join(f'c{i}{SIZE} AS b{i}' for i in ALL)}, ym AS a FROM elim{SIZE} JOIN scales USING (fold_index)"
    return out


def linear(z: str = "z") -> str:
    return " + ".join([*[f"b{i} * {z}{i}" for i in ALL], "a"])


def logistic(l2: float, iterations: int, rate: float) -> dict[str, str]:
    """`logistic(fold_index, b0.., a)` after the last gradient step, and `logits` of all members."""
    zeros = ", ".join(f"0::DOUBLE AS b{i}" for i in ALL)
    steps = ", ".join(f"b{i} - {rate}::DOUBLE * (avg(e * z{i}) + {l2}::DOUBLE * b{i})" for i in ALL)
    names = ", ".join(f"b{i}" for i in ALL)
    return {
        "descent": f"""
    SELECT 0 AS it, fold_index, {zeros}, 0::DOUBLE AS a FROM scales UNION ALL
    SELECT it + 1, fold_index, {steps}, a - {rate}::DOUBLE * avg(e) FROM (
      SELECT it, fold_index, {names}, a, {', '.join(f'z{i}' for i in ALL)},
        {SIGMOID.format(linear())} - CASE WHEN y > 0 THEN 1 ELSE 0 END AS e
      FROM descent JOIN scaled USING (fold_index) WHERE part = 'train' AND it < {iterations})
    GROUP BY it, fold_index, {names}, a""",
        "logistic": f"SELECT * FROM descent WHERE it = {iterations}",
        "logits": f"SELECT v.*, {linear()} AS logit FROM scaled v JOIN logistic USING (fold_index)",
    }


def platt(l2: float, iterations: int, rate: float) -> dict[str, str]:
    """`halves` of the validation rows, `platt(fold_index, slope, shift)` and `calibrated` rows of every part."""
    return {
        "halves": """
    SELECT * REPLACE (CASE WHEN part <> 'validation' THEN part WHEN rk <= n // 2 THEN 'calibration' ELSE 'selection' END AS part) FROM (
      SELECT *, row_number() OVER (PARTITION BY fold_index, part ORDER BY decision_ns, sample_id) AS rk,
        count(*) OVER (PARTITION BY fold_index, part) AS n FROM logits)""",
        "platt_steps": f"""
    SELECT DISTINCT 0 AS it, fold_index, 1::DOUBLE AS slope, 0::DOUBLE AS shift FROM halves WHERE part = 'calibration' UNION ALL
    SELECT it + 1, fold_index, slope - {rate}::DOUBLE * (avg(e * logit) + {l2}::DOUBLE * slope), shift - {rate}::DOUBLE * avg(e) FROM (
      SELECT it, fold_index, slope, shift, logit, {SIGMOID.format('slope * logit + shift')} - CASE WHEN y > 0 THEN 1 ELSE 0 END AS e
      FROM platt_steps JOIN halves USING (fold_index) WHERE part = 'calibration' AND it < {iterations})
    GROUP BY it, fold_index, slope, shift""",
        "platt": f"SELECT * FROM platt_steps WHERE it = {iterations}",
        "calibrated": f"""
    SELECT h.*, {SIGMOID.format('logit')} AS p_raw, {SIGMOID.format('slope * logit + shift')} AS p_calibrated
    FROM halves h JOIN platt USING (fold_index)""",
    }


def stumps(rounds: int, rate: float, minimum_leaf: int, limit: int) -> dict[str, str]:
    """`stumps(round, ...)` and `boosted(fold_index, part, sample_id, ..., pred)` of all members."""
    picks = "place = cnt // 2" if limit == 1 else f"list_contains(list_transform(range({limit}), lambda i: i * (cnt - 1) // {limit - 1}), place)"
    values = ", ".join(f"{{'feature': {i}, 'v': x{i}}}" for i in ALL)
    out = {
        "unpivoted": f"SELECT fold_index, part, sample_id, y, unnest([{values}], recursive := true) FROM members",
        "counted": "SELECT fold_index, feature, v, count(*) AS c FROM unpivoted WHERE part = 'train' GROUP BY ALL",
        "placed": """
    SELECT *, sum(c) OVER w AS upto, lead(v) OVER w AS after_v, sum(c) OVER (PARTITION BY fold_index, feature) AS total FROM counted
    WINDOW w AS (PARTITION BY fold_index, feature ORDER BY v)""",
        "usable": f"""
    SELECT fold_index, feature, (v + after_v) / 2 AS mid, row_number() OVER (PARTITION BY fold_index, feature ORDER BY v) - 1 AS place,
      count(*) OVER (PARTITION BY fold_index, feature) AS cnt
    FROM placed WHERE upto >= {minimum_leaf} AND upto <= total - {minimum_leaf} AND after_v IS NOT NULL""",
        "cuts": f"SELECT fold_index, feature, list(mid ORDER BY mid) AS cuts FROM usable WHERE cnt <= {limit} OR {picks} GROUP BY ALL",
        "slots": """
    SELECT fold_index, part, sample_id, y, feature, len(list_filter(cuts, lambda c: c < v)) AS slot FROM unpivoted JOIN cuts USING (fold_index, feature)""",
        "bases": "SELECT fold_index, avg(y) AS base FROM members WHERE part = 'train' GROUP BY ALL",
        "pred0": "SELECT m.*, base AS pred FROM members m JOIN bases USING (fold_index)",
    }
    for r in range(rounds):
        out |= {
            f"cells{r}": f"""
    SELECT s.fold_index, feature, slot, sum(s.y - pred) AS s, sum((s.y - pred) * (s.y - pred)) AS q, count(*) AS n FROM slots s JOIN pred{r} p
      ON s.fold_index = p.fold_index AND s.part = p.part AND s.sample_id = p.sample_id WHERE s.part = 'train' GROUP BY ALL""",
            f"sides{r}": f"""
    SELECT fold_index, feature, slot, sum(s) OVER w AS ls, sum(n) OVER w AS ln, sum(s) OVER (PARTITION BY fold_index, feature) AS ts,
      sum(n) OVER (PARTITION BY fold_index, feature) AS tn, sum(q) OVER (PARTITION BY fold_index, feature) AS tq FROM cells{r} WINDOW w AS (PARTITION BY fold_index, feature ORDER BY slot)""",
            f"best{r}": f"""
    SELECT fold_index, {r} AS round, feature, cuts[slot + 1] AS threshold, {rate}::DOUBLE * ls / ln AS lv, {rate}::DOUBLE * (ts - ls) / (tn - ln) AS rv, gain
    FROM (SELECT *, row_number() OVER (PARTITION BY fold_index ORDER BY round(gain / tq, {GAIN_DIGITS}) DESC, feature, slot) AS rk FROM (
      SELECT b.*, cuts, ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) - ts * ts / tn AS gain
      FROM sides{r} b JOIN cuts USING (fold_index, feature) WHERE slot < len(cuts) AND ln >= {minimum_leaf} AND tn - ln >= {minimum_leaf}) WHERE round(gain / tq, {GAIN_DIGITS}) > 0)
    WHERE rk = 1""",
            f"pred{r + 1}": f"""
    SELECT p.* REPLACE (pred + coalesce(CASE WHEN [{', '.join(f'x{i}' for i in ALL)}][feature + 1] <= threshold THEN lv ELSE rv END, 0) AS pred)
    FROM pred{r} p LEFT JOIN best{r} USING (fold_index)""",
        }
    out["stumps"] = " UNION ALL ".join(f"SELECT * FROM best{r}" for r in range(rounds))
    out["boosted"] = f"SELECT * FROM pred{rounds}"
    return out


FEATURE_NAME = "CASE feature " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(FEATURES)) + " END"
