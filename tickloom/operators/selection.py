"""Comparing settings over many runs and choosing one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.metrics import ratio, robust

COMBO = ("candidate_id", "ticker", "encoder_mode")

# Weights of the run score, gates of the encoder choice, floors of the promotion.
W_NET_SHARPE, W_COVERAGE, W_AUC, W_TURNOVER = 0.60, 0.30, 0.15, 0.01
STD_WEIGHT = 0.5
MIN_DELTA_ROBUST, MIN_DELTA_NET_SHARPE = 0.02, 0.05
MIN_NET_SHARPE, MIN_COVERAGE, MIN_VALID_FOLDS = 0.0, 0.83, 0.83


def score_runs(
    runs: DataFrame, w_net: float = W_NET_SHARPE, w_coverage: float = W_COVERAGE, w_auc: float = W_AUC,
    w_turnover: float = W_TURNOVER,
) -> DataFrame:
    """``valid_folds_ratio`` (0 without configured folds) and the weighted ``score`` of every run."""
    return runs.withColumns({
        "valid_folds_ratio": ratio(F.col("cv_folds_valid"), F.col("cv_folds_configured")),
        "score": F.col("net_sharpe") * w_net + F.col("coverage_ratio") * w_coverage + F.col("auc") * w_auc
        - F.col("turnover") * w_turnover,
    })


def _summary(runs: DataFrame, keys: Sequence[str], std_weight: float, *more: Column) -> DataFrame:
    means = {"auc": "auc_mean", "accuracy": "accuracy_mean", "turnover": "turnover_mean", "valid_folds_ratio": "valid_folds_ratio_mean"}
    both = {"score": "score", "net_sharpe": "net_sharpe", "coverage_ratio": "coverage"}
    aggs = [F.avg(c).alias(f"{n}_mean") for c, n in both.items()] + [F.stddev_samp(c).alias(f"{n}_std") for c, n in both.items()]
    aggs += [F.avg(c).alias(n) for c, n in means.items()]
    out = runs.groupBy(*keys).agg(*aggs, F.count("run_number").alias("runs"), *more)
    return out.withColumns({
        "robust_score": robust(F.col("score_mean"), F.col("score_std"), std_weight),
        "robust_net_sharpe": robust(F.col("net_sharpe_mean"), F.col("net_sharpe_std"), std_weight),
    })


def summarize_combos(runs: DataFrame, std_weight: float = STD_WEIGHT) -> DataFrame:
    """Means and deviations over the seeds of each (candidate, ticker, encoder)."""
    return _summary(runs, COMBO, std_weight)


def with_parameters(summary: DataFrame, candidates: DataFrame) -> DataFrame:
    """Summary rows with the parameters of their candidate (kept without, when unknown)."""
    return summary.join(candidates, F.col("candidate_id") == F.col("id"), "left")


def choose_encoders(
    combos: DataFrame, min_delta_robust: float = MIN_DELTA_ROBUST, min_delta_net: float = MIN_DELTA_NET_SHARPE
) -> DataFrame:
    """Per (candidate, ticker) the row of the encoder to use, and why: ``tcn`` only when it
    clears both gates against ``off``."""
    row = F.struct(*combos.columns)
    pair = combos.groupBy("candidate_id", "ticker").agg(
        *[F.max_by(row, F.when(F.col("encoder_mode") == e, F.col("robust_score"))).alias(e) for e in ("off", "tcn")]
    )
    better = (F.col("tcn.robust_score") - F.col("off.robust_score") >= min_delta_robust) & (
        F.col("tcn.net_sharpe_mean") - F.col("off.net_sharpe_mean") >= min_delta_net
    )
    reason = (
        F.when(F.col("tcn").isNull(), "only_off_available").when(F.col("off").isNull(), "only_tcn_available")
        .when(better, "tcn_improves_robust_and_net").otherwise("off_is_more_robust")
    )
    chosen = F.when(reason.isin("only_tcn_available", "tcn_improves_robust_and_net"), F.col("tcn")).otherwise(F.col("off"))
    return (
        pair.filter(F.col("tcn").isNotNull() | F.col("off").isNotNull())
        .select(chosen.alias("_c"), reason.alias("encoder_selection_reason"))
        .select("_c.*", "encoder_selection_reason")
    )


def selected_runs(runs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Runs of the chosen encoder of their (candidate, ticker)."""
    return runs.join(chosen.select(*COMBO), list(COMBO), "left_semi")


def summarize_candidates(runs: DataFrame, chosen: DataFrame, std_weight: float = STD_WEIGHT) -> DataFrame:
    return _summary(
        selected_runs(runs, chosen), ["candidate_id"], std_weight, F.count_distinct("ticker").alias("tickers")
    ).orderBy(F.desc("robust_score"), "candidate_id")


def choose_best(
    summary: DataFrame, min_net_sharpe: float = MIN_NET_SHARPE, min_coverage: float = MIN_COVERAGE,
    min_valid_folds: float = MIN_VALID_FOLDS,
) -> DataFrame:
    """The candidate with the best robust score among those above all floors; when there is
    none, among all of them, with ``relaxed`` set.  Equal scores (to 12 digits) go by id."""
    meets = F.coalesce(
        (F.col("net_sharpe_mean") >= min_net_sharpe) & (F.col("coverage_mean") >= min_coverage)
        & (F.col("valid_folds_ratio_mean") >= min_valid_folds), F.lit(False),
    )
    return (
        summary.withColumn("_meets", meets).orderBy(F.desc("_meets"), F.desc(F.round("robust_score", 12)), "candidate_id").limit(1)
        .withColumn("relaxed", ~F.col("_meets")).drop("_meets")
    )


def encoder_vote(chosen: DataFrame) -> DataFrame:
    """Most frequent encoder over the tickers of each candidate (the first by name of equals), and the counts."""
    votes = chosen.groupBy("candidate_id", "encoder_mode").agg(F.count(F.lit(1)).alias("_n"))
    order = F.struct("_n", (F.col("encoder_mode") == "off").cast("int"))
    return votes.groupBy("candidate_id").agg(
        F.max_by("encoder_mode", order).alias("encoder_mode"), F.max("_n").alias("votes"), F.sum("_n").alias("n_tickers")
    )


def encoder_by_ticker(chosen: DataFrame, best: DataFrame) -> DataFrame:
    """Ticker to encoder for the best candidate, one row per ticker (a driver-side map would grow with the panel)."""
    return chosen.join(best.select("candidate_id"), "candidate_id", "left_semi").select("candidate_id", "ticker", "encoder_mode")


def normalize_candidates(df: DataFrame, forced_stochastic: bool | None = None, forced_budget: str | None = None) -> DataFrame:
    """Defaults, types, ordered threshold band, known budgets; forced values override.

    Wants ``idx``, the position of the candidate in its list.
    """
    def opt(name: str, default, kind: str) -> Column:
        value = F.col(name).try_cast(kind) if name in df.columns else F.lit(None).cast(kind)
        return F.coalesce(value, F.lit(default).cast(kind))

    lo, hi = opt("conservative_th_min", 0.60, "double"), opt("conservative_th_max", 0.64, "double")
    budget = F.lower(opt("xgb_candidate_budget", "medium", "string"))
    own_id = F.col("id").cast("string") if "id" in df.columns else F.lit(None).cast("string")
    return df.select(
        F.coalesce(own_id, F.concat(F.lit("candidate_"), (F.col("idx") + 1).cast("string"))).alias("id"),
        opt("target_coverage", 0.16, "double").alias("target_coverage"),
        opt("trade_ratio_floor", 0.09, "double").alias("trade_ratio_floor"),
        F.least(lo, hi).alias("conservative_th_min"), F.greatest(lo, hi).alias("conservative_th_max"),
        opt("calibration_method", "sigmoid", "string").alias("calibration_method"),
        opt("conservative_percentile_threshold", 70, "int").alias("conservative_percentile_threshold"),
        (F.lit(forced_stochastic) if forced_stochastic is not None else opt("xgb_stochastic_mode", True, "boolean")).alias("xgb_stochastic_mode"),
        (F.lit(forced_budget) if forced_budget else F.when(budget.isin("low", "medium", "high"), budget).otherwise("medium")).alias("xgb_candidate_budget"),
    )


def ticker_list(raw: Column) -> Column:
    """Comma-separated names to an array of trimmed upper-case tickers."""
    return F.filter(F.transform(F.split(raw, ","), lambda x: F.upper(F.trim(x))), lambda x: x != "")


def write_report(runs: DataFrame, combos: DataFrame, chosen: DataFrame, summary: DataFrame, best: DataFrame, root: str) -> None:
    """One JSON dataset per part of the report, and the summary as CSV."""
    for name, part in {"per_run": runs, "per_combo_summary": combos, "encoder_selection": chosen, "summary": summary,
                       "best_candidate": best}.items():
        part.write.mode("overwrite").json(f"{root}/{name}")
    summary.write.mode("overwrite").option("header", True).csv(f"{root}/summary_csv")
