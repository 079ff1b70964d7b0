"""Registered queries against DuckDB.  A sample by default; TICKLOOM_ORACLE=all runs every one."""
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TICKLOOM_SF", "/root/testdata/sf0.001")
SAMPLE = ["label_shares", "rolling_volatility", "exponential_means", "directional_strength", "fold_results", "recommendations",
          "percent_barrier_labels", "run_statistics", "best_candidate"]
TABLES = ("lineitem", "orders", "part")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def plain(value):
    if pd.isna(value):
        return None
    if hasattr(value, "isoformat"):
        return str(value)[:10]
    return value if isinstance(value, str) else float(value)


def table(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(plain(v) for v in row) for row in pdf[cols].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("TICKLOOM_ORACLE") == "all" else SAMPLE)
def test_query_equals_sql(spark, con, name):
    got = table(entry.queries()[name](spark, SF).toPandas())
    want = table(con.execute(entry.oracle_sql()[name]).df())
    assert got == want


def test_every_oracle_has_a_query_and_the_entry_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("profile,split", [("balanced", False), ("conservative", True)])
def test_forecast_gives_one_decision_per_ticker(spark, tmp_path, profile, split):
    from tickloom.operators.models import BoostSetting
    from tickloom.plans.forecast import forecast
    from tickloom.plans.market import Market
    from tickloom.settings import Settings

    market = Market(spark, SF, root=str(tmp_path))
    # Half of these bars have no index and so no training row.
    s = Settings(risk_profile=profile, train_rows=100, val_rows=40, min_train=80, min_val=20, n_splits=3)
    run = forecast(market, s, BoostSetting(2, 0.3, 3, 1.0, 1.0, 1), regime_split=split)
    assert run.recommendations.count() == market.bars().select("ticker").distinct().count()
    preds = run.predictions.selectExpr("min(p_raw)", "max(p_raw)", "count(*)", "count(distinct ticker, fold, rn)").first()
    assert 0 <= preds[0] <= preds[1] <= 1 and preds[2] == preds[3] > 0
    folds = run.results.count()
    assert folds + run.skipped.filter("reason <> 'insufficient_trades'").count() == market.members(s, features=market.training_features()[0]).select("ticker", "fold").distinct().count()
    used = {r[0] for r in run.results.select("calibration_method").distinct().collect()}
    assert used <= ({"none"} if split else {"none", "isotonic", "sigmoid"})
    assert len(set(run.trees.first()["feature"])) > 1 and len(market.contract().final) >= 15
