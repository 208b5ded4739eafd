"""Queries over the baselines' fold report, against their SQL; no module uses a name that it does not have."""

import builtins
import dis
import importlib
import pkgutil
from pathlib import Path
from types import CodeType

import duckdb
import pytest

import __spark_entry__
import tidepanel
from scripts.verify import table_of

SMALL = "/root/testdata/sf0.001"
NAMES = [
    "d13_cross_fold_aggregate",
    "d14_model_dominance",
    "d15_candidate_decision",
    "d15b_candidate_decision_by_fold",
    "p11_baseline_fold_evaluation",
]


@pytest.mark.parametrize("name", NAMES)
def test_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    want = table_of([c[0] for c in want.description], want.fetchall())
    got = __spark_entry__.queries()[name](spark, SMALL)
    assert table_of(got.columns, [tuple(r) for r in got.collect()]) == want and want[1]


def codes(code):
    yield code
    for inner in code.co_consts:
        if isinstance(inner, CodeType):
            yield from codes(inner)


def test_every_global_name_is_there():
    unknown = []
    for found in pkgutil.walk_packages(tidepanel.__path__, "tidepanel."):
        module = importlib.import_module(found.name)
        path = Path(module.__file__)
        for code in codes(compile(path.read_text(), path, "exec")):
            used = {i.argval for i in dis.get_instructions(code) if i.opname == "LOAD_GLOBAL"}
            unknown += [(found.name, code.co_name, name) for name in used if not hasattr(module, name) and not hasattr(builtins, name)]
    assert unknown == []
