"""Where the catalog modules register their queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.catalog.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a `Tables -> DataFrame` function, with its SQL when it has one."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = without_negative_zero(sql)
        return build

    return register


def without_negative_zero(sql: str) -> str:
    """Make every `round(...)` of the SQL yield 0.0 where it would yield -0.0."""
    out, at = [], 0
    while (found := sql.find("round(", at)) >= 0:
        end, depth = found + len("round("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        call = sql[found:end]
        out.append(f"{sql[at:found]}(CASE WHEN {call} = 0 THEN 0.0 ELSE {call} END)")
        at = end
    return "".join(out) + sql[at:]


def rounded(df: DataFrame, digits: int, columns: Sequence[str] | None = None) -> DataFrame:
    """Round every double (or the named columns), as the SQL side does."""
    names = columns or [n for n, kind in df.dtypes if kind == "double"]
    # Adding zero turns -0.0 into 0.0.
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})


def six(value):
    """Rounded to six places by way of a decimal, so that an exact half rounds alike in every engine."""
    return F.round(value.cast("decimal(28,9)"), 6).cast("double")


def six_sql(value: str) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(28,9)), 6) AS DOUBLE)"
