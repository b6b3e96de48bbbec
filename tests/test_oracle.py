"""Every query that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from kindred import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "documents", "labels", "events", "lineitem", "orders", "part", "supplier", "nation", "region")


def canonical(df):
    def text(v):
        if v is None or (isinstance(v, float) and np.isnan(v)):
            return "None"
        if isinstance(v, (float, np.floating)):
            return repr(float(v))
        return str(list(v)) if isinstance(v, (list, np.ndarray)) else str(v)

    rows = df[sorted(df.columns)].map(text)
    return sorted(map(tuple, rows.values.tolist()))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_equals_sql(spark, duck, name):
    ours, theirs = Q.QUERIES[name](spark, SF).toPandas(), duck.execute(Q.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["d_12_planned_probes", "f_08_candidate_budget", "c_06_multipass_blocker", "x_83_features", "m_02_discovery", "m_03_intersection_reasons", "m_14_validator", "e_16_decision_features"])
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0
