import json

import pytest
from pyspark.sql import functions as F

from tickloom.operators import contract, profile, runlog, selection, sequences
from tickloom.settings import SEED_FEATURES


def runs(spark):
    rows = [(1, "MSFT", ["macd"], 0.5, 0.5, float("nan"), -0.10), (2, "MSFT", ["macd", "lstm_latent_0"], 0.6, 0.6, 1.2, -0.05),
            (3, "AAPL", ["macd"], 0.7, 0.55, 0.4, -0.20)]
    return spark.createDataFrame(rows, "run_number int, ticker string, features_used array<string>, accuracy double, auc double, sharpe_ratio double, max_drawdown double")


def test_average_sharpe_ignores_missing_values(spark):
    row = runlog.metadata(runlog.run_records(runs(spark).filter("run_number < 3"))).first()
    assert row["average_sharpe"] == pytest.approx(1.2) and row["best_sharpe"] == pytest.approx(1.2)
    assert row["total_runs"] == 2 and row["auc_variance"] == pytest.approx(0.0025)


def test_records_take_defaults_and_count_feature_families(spark):
    rec = runlog.run_records(runs(spark)).filter("run_number = 2").first()
    assert (rec["features"]["lstm_latent_dims"], rec["features"]["technical_features"]) == (1, 1)
    assert rec["metrics"]["precision"] == 0.0 and rec["financial_metrics"]["net_sharpe"] is None


def test_log_round_trip_through_json_parquet_and_csv(spark, tmp_path):
    records = runlog.run_records(runs(spark))
    doc = {"metadata": {"total_runs": 3}, "runs": [json.loads(r) for r in records.toJSON().collect()]}
    path = tmp_path / "log.json"
    path.write_text(json.dumps(doc, indent=2))
    again = runlog.read_log(spark, str(path), f"runs array<{records.schema.simpleString()}>")
    assert again.count() == 3 and again.schema["metrics"] .dataType.fieldNames() == records.schema["metrics"].dataType.fieldNames()
    runlog.append_records(records, str(tmp_path / "log"))
    runlog.append_records(records, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6
    flat = runlog.flatten(records)
    assert len(flat.columns) == 32
    runlog.write_csv(flat, str(tmp_path / "csv"))
    back = runlog.read_csv(spark, str(tmp_path / "csv"), flat.schema)
    assert sorted(r["auc_roc"] for r in back.collect()) == [0.5, 0.55, 0.6]


def test_best_run_works_and_unknown_metric_gives_no_row(spark):
    flat = runlog.flatten(runlog.run_records(runs(spark)))
    assert runlog.best_run(flat, "auc_roc").first()["run_number"] == 2
    assert runlog.best_run(flat, "nothing").count() == 0


def test_baseline_is_frozen_once_per_tag(spark):
    records, none = runlog.run_records(runs(spark)), spark.createDataFrame([], "tag string")
    first = runlog.freeze_baseline(records, none, " v1 ", "msft")
    assert first.first()["run_number"] == 2 and first.first()["tag"] == "v1"
    assert runlog.freeze_baseline(records, first, "v1").count() == 0
    assert runlog.freeze_baseline(records, none, "v2", "TSLA").count() == 0
    assert runlog.freeze_baseline(records, none, " ").count() == 0


def test_features_weak_in_three_of_five_runs_persist(spark):
    rows = [(i, "A", ["x"] if i in (1, 2, 3) else (["y"] if i > 4 else [])) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "run_number int, ticker string, removed_by_importance array<string>")
    got = runlog.persistent_low_importance(runlog.run_records(df)).collect()
    assert [(r["feature"], r["n_runs"]) for r in got] == [("y", 4)]


def test_halves_of_the_log(spark):
    got = {r["metric"]: r for r in runlog.early_vs_recent(runlog.flatten(runlog.run_records(runs(spark))), bucket_rows=2).collect()}
    assert got["accuracy"]["early_mean"] == 0.5 and got["accuracy"]["recent_mean"] == pytest.approx(0.65)
    assert got["accuracy"]["change_percent"] == pytest.approx(30)


SUMMARY = "candidate_id string, robust_score double, net_sharpe_mean double, coverage_mean double, valid_folds_ratio_mean double"


def test_best_candidate_respects_floors(spark):
    df = spark.createDataFrame([("low", 1.9, 0.02, 0.95, 1.0), ("mid", 0.7, 0.61, 0.91, 0.88), ("thin", 2.4, 0.7, 0.41, 0.9)], SUMMARY)
    best = selection.choose_best(df, min_net_sharpe=0.5).first()
    assert (best["candidate_id"], best["relaxed"]) == ("mid", False)


def test_best_candidate_relaxes_when_none_meets_the_floors(spark):
    df = spark.createDataFrame([("one", 0.9, 0.3, 0.5, 0.7), ("two", 1.1, 0.1, 0.6, 0.6)], SUMMARY)
    best = selection.choose_best(df, min_net_sharpe=0.5).first()
    assert (best["candidate_id"], best["relaxed"]) == ("two", True)


def test_encoder_is_switched_only_when_both_gates_pass(spark):
    rows = [("k1", "XX", "off", 0.5, 0.3), ("k1", "XX", "tcn", 0.9, 0.7), ("k2", "XX", "off", 0.8, 0.4),
            ("k2", "XX", "tcn", 0.805, 0.41), ("k3", "YY", "tcn", 0.2, 0.9), ("k4", "YY", "off", 0.6, 0.6)]
    df = spark.createDataFrame(rows, "candidate_id string, ticker string, encoder_mode string, robust_score double, net_sharpe_mean double")
    got = {r["candidate_id"]: (r["encoder_mode"], r["encoder_selection_reason"]) for r in selection.choose_encoders(df).collect()}
    assert got == {"k1": ("tcn", "tcn_improves_robust_and_net"), "k2": ("off", "off_is_more_robust"),
                   "k3": ("tcn", "only_tcn_available"), "k4": ("off", "only_off_available")}
    votes = {r["candidate_id"]: r["encoder_mode"] for r in selection.encoder_vote(selection.choose_encoders(df)).collect()}
    assert votes["k1"] == "tcn"


def test_single_run_has_no_deviation(spark):
    rows = [("c1", "A", "off", 1, 0.5, 0.4, 0.9, 0.6, 0.55, 12.0, 1.0)]
    df = spark.createDataFrame(rows, "candidate_id string, ticker string, encoder_mode string, run_number int, score double, net_sharpe double, "
                               "coverage_ratio double, auc double, accuracy double, turnover double, valid_folds_ratio double")
    row = selection.summarize_combos(df).first()
    assert row["score_std"] is None and row["robust_score"] == 0.5 and row["runs"] == 1


def test_run_score_guards_missing_folds(spark):
    df = spark.createDataFrame([(0, 0, 1.0, 0.5, 0.6, 10.0)], "cv_folds_valid int, cv_folds_configured int, net_sharpe double, coverage_ratio double, auc double, turnover double")
    row = selection.score_runs(df).first()
    assert row["valid_folds_ratio"] == 0.0 and row["score"] == pytest.approx(0.6 + 0.15 + 0.09 - 0.1)


def test_candidates_are_normalised(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text("\n".join(json.dumps(c) for c in [
        {"idx": 0, "id": "a", "conservative_th_min": 0.7, "conservative_th_max": 0.6, "xgb_candidate_budget": "HIGH"},
        {"idx": 1, "xgb_candidate_budget": "huge", "conservative_percentile_threshold": "72"}]))
    got = selection.normalize_candidates(spark.read.json(str(path))).orderBy("id").collect()
    assert (got[0]["conservative_th_min"], got[0]["conservative_th_max"], got[0]["xgb_candidate_budget"]) == (0.6, 0.7, "high")
    assert (got[1]["id"], got[1]["xgb_candidate_budget"], got[1]["conservative_percentile_threshold"]) == ("candidate_2", "medium", 72)
    forced = selection.normalize_candidates(spark.read.json(str(path)), forced_stochastic=False, forced_budget="low").first()
    assert forced["xgb_stochastic_mode"] is False and forced["xgb_candidate_budget"] == "low"


def test_candidates_are_read_in_list_order(spark, tmp_path):
    from tickloom.sources.candidates import read_candidates

    path = tmp_path / "list.json"
    path.write_text(json.dumps([{"target_coverage": 0.2}, {"id": "x", "xgb_stochastic_mode": False}, {}], indent=1))
    got = {r["id"]: r for r in read_candidates(spark, str(path)).collect()}
    assert sorted(got) == ["candidate_1", "candidate_3", "x"]
    assert got["candidate_1"]["target_coverage"] == 0.2 and got["x"]["xgb_stochastic_mode"] is False


def test_ticker_list(spark):
    df = spark.createDataFrame([(" msft, aapl ,,",)], "s string")
    assert df.select(selection.ticker_list(F.col("s")).alias("t")).first()["t"] == ["MSFT", "AAPL"]


def test_report_is_written(spark, tmp_path):
    df = spark.createDataFrame([("c1", 1.0)], "candidate_id string, score double")
    selection.write_report(df, df, df, df, df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "best_candidate")).first()["candidate_id"] == "c1"


# --- contract and profile -----------------------------------------------------------------------

def test_contract_handles_intended_drops(spark):
    df = spark.createDataFrame([(0.1, 1.0, 2.0, 3.0)], "lstm_latent_0 double, macd double, atr double, ema_short double")
    seed = ["lstm_latent_0", "lstm_latent_2", "macd", "atr", "ema_short"]
    c = contract.resolve_contract(df, seed, ["lstm_latent_2"], [], 3)
    assert list(c.requested) == seed and c.missing_unexpected == () and set(c.final) == {"lstm_latent_0", "macd", "atr", "ema_short"}
    with pytest.raises(ValueError):
        contract.resolve_contract(df, seed, min_features=15)
    assert contract.resolve_contract(df, seed, min_features=3).missing_unexpected == ("lstm_latent_2",)


def test_twins_are_dropped_in_favour_of_the_contract_names(spark):
    df = spark.createDataFrame([(1.0,) * 5], "close double, lstm_price_5d double, tcn_price_5d double, lstm_return_5d double, tcn_return_5d double")
    out, dropped = contract.drop_twins(df)
    assert dropped == ["tcn_price_5d", "tcn_return_5d"] and "lstm_price_5d" in out.columns
    assert contract.feature_columns(df, seed=df.columns) == ["close", "lstm_price_5d", "lstm_return_5d"]


def test_earlier_column_of_a_correlated_pair_goes_and_protected_ones_stay(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i % 3), float(i)) for i in range(30)], "a double, b double, c double, macd double")
    out, dropped = contract.drop_correlated(df)
    assert dropped == ["a"] and out.columns == ["b", "c", "macd"]


def test_low_importance_never_drops_protected_columns(spark):
    df = sequences.placeholder_columns(spark.createDataFrame([(1.0, 2.0, 3.0)], "close double, rsi double, mine double"))
    out, dropped = contract.drop_low_importance(df, ["mine", "close"], ["lstm_latent_5"])
    assert set(dropped) == {"lstm_latent_2", "rsi", "mine", "lstm_latent_5"} and "close" in out.columns
    assert len(SEED_FEATURES) == 32


def test_correlations_skip_missing_pairs_and_constants(spark):
    rows = [(1.0, 2.0, 7.0), (2.0, None, 7.0), (3.0, 5.0, 7.0), (4.0, 9.0, 7.0), (None, 1.0, 7.0)]
    df = spark.createDataFrame(rows, "a double, b double, k double").repartition(3)
    pdf = df.toPandas()
    got = {(r["a"], r["b"]): r["r"] for r in profile.correlation_matrix(df, ["a", "b", "k"]).collect()}
    assert got[("a", "b")] == pytest.approx(pdf["a"].corr(pdf["b"])) and got[("a", "k")] is None
    high = profile.high_correlations(df, ["a"], ["b", "k"]).collect()
    assert [(r["a"], r["b"]) for r in high] == [("a", "b")]


def test_profile_flags_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, k double")
    got = {r["feature"]: r for r in profile.column_profile(df, ["a", "k"], distinct=True).collect()}
    assert (got["a"]["n_distinct"], got["k"]["n_distinct"]) == (3, 1)
    assert got["k"]["constant"] and not got["a"]["constant"] and got["a"]["std"] == pytest.approx(df.toPandas().a.std())
