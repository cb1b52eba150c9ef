"""Each core query against its DuckDB SQL, on the smallest tables."""

import math
import os

import pytest

from txnfeat.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = sorted(([plain(v) for v in r] for r in duck.execute(f"select {quoted} from ({ORACLES[name]})").fetchall()), key=repr)
    assert got == want


def test_subset_lists_are_all_there(spark):
    assert {r["list"] for r in QUERIES["subset_selection"](spark, SF).collect()} == {"A", "B", "C"}


@pytest.mark.parametrize(("name", "operators"), [("ledger_full_features", ["Window", "sha2", "SIN"]), ("card_full_features", ["Window", "sha2"]), ("identity_left_join", ["Join LeftOuter"]), ("membership_filter", ["Join LeftSemi"])])
def test_plans_hold_what_they_name(spark, name, operators):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert all(x in plan for x in operators)
