"""A sample of registered queries against their SQL on the smallest tables; the rest is the driver's to compare."""

import os

import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = ["panel_adapter", "macd_events", "price_location", "limit_regime", "market_states", "decile_bins", "asof_financials", "adjusted_prices", "trade_stats", "portfolio_nav", "stop_loss_close", "union_dedupe_latest", "event_sessions", "stream_tumbling", "scan_latest", "trade_hist", "confirm_grid", "signal_mask_confirmed", "signal_momentum", "signal_financial", "signal_quarter", "signal_without_risks", "signal_deep", "pick_rules", "trades_filtered", "exit_indicators", "event_catalogue", "ledger_totals", "positions_marked", "strength_deciles", "report_days", "index_alignment", "market_alert", "score_threshold", "sensitivity", "neighbourhood", "tune_axes", "factor_regimes", "factor_regimes_wider", "case_runner", "null_fills", "ordered_unique", "capacity_plan", "ladder_plan", "capacity_nav", "capacity_occupancy", "capacity_result", "capacity_segments", "tune_capacity", "trades_page", "scan_market", "stock_signals", "trades_with_open", "ledger_lots", "filter_reference", "rule_verdicts", "random_benchmark", "eight_strategies", "cost_reconciliation", "depth_tails", "depth_holding_curve", "confirm_nine", "strength_splits", "layered_entries", "alternative_definitions", "stop_trades", "stop_portfolio", "recompute_changed", "recompute_touched", "published_versions", "reused_stage", "mixed_series", "industry_tree", "pool_free_text"]
TABLES = "region nation customer supplier part orders lineitem events".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def shown(x):
    if x is None or x is pd.NaT or x is pd.NA or x != x:
        return ""
    if hasattr(x, "year"):
        return str(pd.Timestamp(x))
    return f"{float(x):.5f}" if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)


def rows(frame):
    frame = frame.reindex(sorted(frame.columns), axis=1)
    return sorted(tuple(map(shown, r)) for r in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    from tessera.plans import catalog

    got = catalog.QUERIES[name](spark, FOLDER)
    want = con.execute(catalog.ORACLE[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.toPandas()) == rows(want)


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_files_round_trip(spark, tmp_path):
    from tessera.sources import files as S

    df = spark.createDataFrame([(1, "a", None), (2, "b", 0.5)], "k int, s string, x double")
    S.write_parquet(df, f"{tmp_path}/p", ["k"])
    assert S.read_columns(spark, f"{tmp_path}/p", ["s"]).count() == 2
    S.write_json(df, f"{tmp_path}/j")
    assert '"x":null' in "".join(r.value for r in spark.read.text(f"{tmp_path}/j").collect())
    S.write_csv(df, f"{tmp_path}/c", ["s", "x"])
    # the bytes themselves, as the text reader leaves a byte-order mark out
    assert any(f.read_bytes().startswith(b"\xef\xbb\xbfs,x") for f in (tmp_path / "c").glob("part-*"))
    (tmp_path / "t.json").write_text('{"data": {"item": [{"thscode": "1.SH", "name": "x", "list_date": null, "exchange": "SH"}]}}')
    (tmp_path / "m.json").write_text('{"1.SH": {"code": "c", "name": "n"}}')
    (tmp_path / "s.json").write_text('[{"date_ms": 1704067200000, "close_price": 1.0}, {"date": "2024-01-01", "close_price": 2.0}]')
    assert S.read_tickers(spark, f"{tmp_path}/t.json").collect()[0].exchange == "SH"
    assert S.read_code_map(spark, f"{tmp_path}/m.json").collect()[0].ind_name == "n"
    assert [r.close_price for r in S.read_series(spark, f"{tmp_path}/s.json").collect()] == [2.0]
    a, b = S.write_version(df, f"{tmp_path}/v"), S.write_version(df, f"{tmp_path}/v")
    assert a != b and spark.read.parquet(b).count() == 2
