import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_signals import K, frame

from tickloom.functions.metrics import sharpe
from tickloom.operators import backtest, evaluation, recommendation
from tickloom.settings import Settings


def test_costs_and_drawdown_equal_the_loops(spark):
    rng = np.random.default_rng(2)
    ret, size = rng.normal(0, 0.05, 40), np.where(rng.random(40) < 0.5, rng.random(40), 0.0)
    df = backtest.drawdown(backtest.with_costs(frame(spark, [0.5] * 40, ret, size=size.tolist()), K), "gross", K)
    out = df.toPandas().sort_values("rn")
    turn = np.abs(size - np.concatenate([[0.0], size[:-1]]))
    assert np.allclose(out.turnover, turn) and np.allclose(out.net, ret * size - turn * 0.0025)
    value = np.cumprod(1 + ret * size)
    assert np.allclose(out.drawdown, value / np.maximum.accumulate(value) - 1)
    row = backtest.net_metrics(df, K).first()
    net = ret * size - turn * 0.0025
    assert row["net_sharpe"] == pytest.approx((net.mean() - 0.02 / 252) / net.std() * math.sqrt(252))


@pytest.mark.parametrize("values", [[0.01], [0.01, 0.01, 0.01]])
def test_sharpe_is_missing_below_two_rows_or_without_variation(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "r double")
    assert df.agg(sharpe(F.col("r"))).first()[0] is None


def test_ranking_measures_with_ties(spark):
    y = [0, 1, 0, 1, 1, 0, 0, 1]
    p = [0.1, 0.4, 0.4, 0.4, 0.8, 0.8, 0.2, 0.9]
    df = frame(spark, p, y=y)
    pos, neg = [a for a, b in zip(p, y) if b], [a for a, b in zip(p, y) if not b]
    auc = np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg])
    assert evaluation.roc_auc(df, K).first()["auc"] == pytest.approx(auc)
    ap, before = 0.0, 0
    for th in sorted(set(p), reverse=True):
        hit = sum(b for a, b in zip(p, y) if a >= th)
        ap += (hit - before) / sum(y) * hit / sum(a >= th for a in p)
        before = hit
    assert evaluation.average_precision(df, K).first()["aucpr"] == pytest.approx(ap)


def test_calibration_bins_use_the_edges(spark):
    rng = np.random.default_rng(11)
    bins, ece = np.linspace(0, 1, 11), 0.0
    # Scores inside the bins and on all of their edges.
    p = [*rng.random(29).round(4).tolist(), *bins.tolist()]
    y = rng.integers(0, 2, len(p)).tolist()
    for i in range(10):
        inside = [(a >= bins[i]) & ((a < bins[i + 1]) or (i == 9 and a <= 1)) for a in p]
        if any(inside):
            ece += abs(np.mean(np.array(y)[inside]) - np.mean(np.array(p)[inside])) * sum(inside) / len(p)
    df = frame(spark, p, y=y)
    assert evaluation.calibration_error(df, K).first()["ece"] == pytest.approx(ece)
    assert evaluation.brier_score(df, K).first()["brier"] == pytest.approx(np.mean((np.array(p) - y) ** 2))


def test_fold_results_skip_folds_with_few_trades_and_agree_with_the_single_operators(spark):
    rng = np.random.default_rng(4)
    n = 50
    p, y, ret = rng.random(n).round(2), rng.integers(0, 2, n), rng.normal(0, 0.02, n)
    df = frame(spark, p, ret, y).withColumns({
        "signal": (F.col("p") > 0.9).cast("int"), "size": F.when(F.col("p") > 0.9, 0.5).otherwise(0.0), "used_buy": F.lit(0.9),
        "rejected": F.when(F.col("p") <= 0.9, "threshold"), "n_train": F.lit(400), "relaxed": F.lit(0),
        **{c: F.lit(0) for c in ("gate_cut", "cap_cut", "skipped_uncertain", "skipped_low_confidence")},
        "stats": F.struct(F.lit(5).cast("long").alias("n_trades"), F.lit(0.1).alias("trade_ratio")),
    })
    row = backtest.fold_results(df).first()
    assert row["auc"] == pytest.approx(evaluation.roc_auc(df, K).first()["auc"])
    assert row["aucpr"] == pytest.approx(evaluation.average_precision(df, K).first()["aucpr"])
    assert (row["reason"] is None) == (int((p > 0.9).sum()) >= 3)
    assert backtest.fold_results(df.withColumn("size", F.lit(0.0))).first()["reason"] == "insufficient_trades"


def test_fold_accounting_counts_valid_and_skipped(spark):
    results = spark.createDataFrame([("A", 1), ("A", 2)], "ticker string, fold int")
    skipped = spark.createDataFrame([("A", 3, "insufficient_validation_size")], "ticker string, fold int, reason string")
    row = backtest.fold_accounting(results, skipped).first()
    assert (row["n_folds_total"], row["n_folds_valid"], row["n_folds_skipped"]) == (3, 2, 1)
    assert row["skip_reasons"] == ["insufficient_validation_size"]


@pytest.mark.parametrize("p,threshold,allowed,state", [
    (0.72, 0.68, True, "WATCHLIST"), (0.9, 0.68, False, "NO_TRADE"), (0.95, 0.68, True, "ENTER_FULL"),
    (0.80, 0.68, True, "ENTER_SMALL"), (0.60, 0.68, True, "WATCHLIST"),
])
def test_decision_states(spark, p, threshold, allowed, state):
    d = recommendation.decide(F.lit(p), F.lit(threshold), F.lit(0.08), F.lit(-0.04), 0.002, F.lit(allowed))
    row = spark.range(1).select(d.alias("d")).first()["d"]
    assert row["state"] == state
    assert row["expected_value"] == pytest.approx(p * 0.08 - (1 - p) * 0.04 - 0.002)


def test_ensemble_defaults_without_folds_and_ladder_ends(spark):
    future = spark.createDataFrame([("A", 1, 0.7), ("A", 2, 0.9)], "ticker string, fold int, probability double")
    last = spark.createDataFrame([("A", 100.0, 2.0), ("B", 50.0, 1.0)], "ticker string, last_price double, volatility double").withColumns(
        {"last_date": F.lit("2024-01-31").cast("date"), "vol_metric": F.lit("rolling_std_20d")})
    ens = {r["ticker"]: r for r in recommendation.ensemble_summary(future, last).collect()}
    assert ens["B"]["avg_prob"] == 0.5 and ens["A"]["consensus"] == "Low" and ens["A"]["recommendation_quality"] == pytest.approx(0.6)
    rec = recommendation.recommend(recommendation.ensemble_summary(future, last), last, Settings())
    ladder = recommendation.forecast_ladder(rec).filter("ticker = 'A'").orderBy("h").collect()
    assert len(ladder) == 20 and str(ladder[0]["date"]) == "2024-02-01"
    assert ladder[-1]["forecast_price"] == pytest.approx(100 * (1 + 0.05 * (1 - math.exp(-3)) * 0.8))
    assert ladder[-1]["forecast_probability"] == pytest.approx(0.8 * 0.9)
    assert '"k_tp":2.5' in recommendation.payload(rec).first()["payload"]
