"""Registered queries against their SQL twins. All of them with ``TIDEMARK_ALL_ORACLES=1``, else one per family."""

import os

import duckdb
import pytest

from tidemark.plans.registry import load
from tools.check_oracles import TABLES, rows_of

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()
SAMPLE = ("S1_text_scan", "P6_category_flags", "J6_as_of", "A11_baseline_table", "W3_lookback_rise", "T5_thinned_curve", "C9_event_axis", "C14_wide_table", "E2_average_precision", "E8_calibration_error",
          "E10_calibration_slope", "E14_two_level", "L1_group_split", "D1_deployment", "D11_outcome_gradient", "Q3_independent_recount", "ST1_stream_windows", "flagship_feature_auroc")
NAMES = sorted(ORACLES) if os.environ.get("TIDEMARK_ALL_ORACLES") else SAMPLE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(ORACLES[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())
