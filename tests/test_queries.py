"""Queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quillstone.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
SOME = ["lake_normalise_quarantine", "lake_daily_bars", "join_asof_snapshot", "join_asof_per_code", "primitives_moments", "primitives_recursive", "formulas_wq001_008", "formulas_gtja160_175", "eval_information_coefficients", "eval_grouping_sets", "minute_core", "minute_market_residuals", "minute_rank_features", "minute_volume_events", "minute_volume_up_returns", "minute_adjusted_amounts", "minute_relative_volume_ranks", "minute_abnormal_flows", "minute_traded_costs", "minute_smart_pooled", "minute_periodicity", "formulas_blocked", "formulas_burnt_in", "panel_benchmark_fill", "primitives_weights", "wide_primitives", "wide_formulas_wq", "wide_formulas_gtja", "wide_deciles", "formulas_imported", "eval_batches_resumed", "eval_cached_labels", "lake_validation", "store_versioned_days", "minute_exclusions", "portfolio_staggered_vintages", "risk_style_exposures"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def _norm(records, columns):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    tidy = lambda v: round(v, 7) + 0.0 if isinstance(v, float) else str(v)[:19] if hasattr(v, "isoformat") else v
    return sorted((tuple(tidy(r[i]) for i in at) for r in records), key=repr)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    cursor = db.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert _norm([tuple(r) for r in df.collect()], df.columns) == _norm(cursor.fetchall(), columns)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_sql_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
