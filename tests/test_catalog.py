"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from bitloom.operators.components import labels
from bitloom.plans import catalog
from bitloom.plans.dialect import TABLES

SF = "/root/testdata/sf0.001"


def value(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


CORE = [n for n in catalog.oracle_sql() if not n.startswith("rule_")] + ["rule_7_2_1_001", "rule_7_3_1_001", "rule_7_4_5_001", "rule_7_4_9_001"]


@pytest.mark.parametrize("name", CORE)
def test_matches_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted((tuple(value(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = con.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert ours == sorted((tuple(value(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)


def test_components_join_diagonals():
    import numpy as np

    assert labels(np.array([0, 1, 1, 5]), np.array([0, 1, 4, 5]), 24).tolist() == [0, 0, 28, 125]
