"""The log of runs: nested records, flattening, summaries and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.series import div, number_rows

RUNTIME_FIELDS = (
    "mode", "objective", "risk_profile", "cost_bps", "slippage_bps", "cv_scheme", "seq_encoder", "target_coverage",
    "threshold_search", "trade_ratio_floor", "conservative_th_min", "conservative_th_max",
)


def _opt(df: DataFrame, name: str, default, kind: str) -> Column:
    if name not in df.columns:
        return F.lit(default).cast(kind)
    value = F.col(name).cast(kind)
    return value if default is None else F.coalesce(value, F.lit(default).cast(kind))


def finite(c: str | Column) -> Column:
    """NaN and infinity as null: the log keeps missing numbers as null only."""
    value = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def run_records(runs: DataFrame) -> DataFrame:
    """Flat run rows to nested records; missing fields take the log's defaults.

    Wants ``run_number``, ``ticker``, ``run_date`` and ``features_used`` (array of names).
    """
    def num(name: str, default: float | None = 0.0) -> Column:
        value = _opt(runs, name, None, "double")
        value = F.when(~F.isnan(value), value)
        return value if default is None else F.coalesce(value, F.lit(default))

    def count(name: str) -> Column:
        return _opt(runs, name, 0, "long")

    names = _opt(runs, "features_used", None, "array<string>")
    names = F.coalesce(names, F.array().cast("array<string>"))
    contract = F.struct(*[
        F.coalesce(_opt(runs, c, None, "array<string>"), F.array().cast("array<string>")).alias(c)
        for c in ("removed_by_corr", "removed_by_importance")
    ])
    return runs.select(
        F.col("run_number").cast("long").alias("run_number"),
        _opt(runs, "timestamp", None, "timestamp").alias("timestamp"),
        _opt(runs, "ticker", "UNKNOWN", "string").alias("ticker"),
        _opt(runs, "run_date", None, "date").alias("date"),
        count("n_folds_valid").alias("fold"),
        F.struct(
            F.size(names).alias("count"), names.alias("names"),
            F.size(F.filter(names, lambda x: F.contains(x, F.lit("lstm_latent")))).alias("lstm_latent_dims"),
            F.size(F.filter(names, lambda x: ~F.contains(x, F.lit("lstm")))).alias("technical_features"),
        ).alias("features"),
        contract.alias("features_contract"),
        F.struct(
            count("train_size").alias("train_size"), count("test_size").alias("test_size"),
            (count("train_size") + count("test_size")).alias("total_samples"),
        ).alias("dataset"),
        F.struct(
            *[_opt(runs, c, None, "long").alias(c) for c in ("n_folds_configured", "n_folds_valid", "n_folds_skipped")],
            F.coalesce(_opt(runs, "skip_reasons", None, "array<string>"), F.array().cast("array<string>")).alias("skip_reasons"),
        ).alias("cv"),
        F.struct(
            num("accuracy").alias("accuracy"), num("precision").alias("precision"), num("recall").alias("recall"),
            num("f1").alias("f1_score"), num("auc").alias("auc_roc"), num("auc_pr").alias("auc_pr"),
        ).alias("metrics"),
        F.struct(
            # A Sharpe ratio given as NaN is missing, not 0.
            num("sharpe_ratio", None if "sharpe_ratio" in runs.columns else 0.0).alias("sharpe_ratio"),
            num("net_sharpe", None).alias("net_sharpe"),
            num("max_drawdown").alias("max_drawdown"), num("total_return").alias("total_return"),
            num("net_return", None).alias("net_return"), num("turnover", None).alias("turnover"), num("win_rate").alias("win_rate"),
        ).alias("financial_metrics"),
        *[num(c, None).alias(c) for c in ("coverage_ratio", "trade_coverage")],
        *[count(c).alias(c) for c in ("n_long_signals_raw", "n_long_signals_post_filters")],
        *[num(c, None).alias(c) for c in ("ev_mean_fold", "calibration_error", "recommendation_quality")],
        F.coalesce(_opt(runs, "model_params", None, "map<string,double>"), F.create_map().cast("map<string,double>")).alias("model_config"),
        F.struct(*[count(c).alias(c) for c in ("buy_signals", "sell_signals", "hold_signals")]).alias("predictions"),
        F.struct(*[_opt(runs, c, None, "string").alias(c) for c in RUNTIME_FIELDS]).alias("runtime"),
        F.coalesce(_opt(runs, "timings", None, "map<string,double>"), F.create_map().cast("map<string,double>")).alias("timings"),
        _opt(runs, "notes", "", "string").alias("notes"),
    )


def append_records(records: DataFrame, path: str) -> None:
    records.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, schema=None, field: str = "runs") -> DataFrame:
    """Runs of a ``{metadata, runs: [...]}`` JSON document of any layout, one row per run; a document is one task's work
    (``sources.json_log`` reads a document with line breaks by many tasks)."""
    reader = spark.read.option("multiLine", True)
    document = (reader.schema(schema) if schema else reader).json(path)
    return document.select(F.explode(field).alias("r")).select("r.*")


def flatten(records: DataFrame) -> DataFrame:
    """The flat table of the log, one row per run."""
    cv, data, fin = "cv", "dataset", "financial_metrics"
    paths = {
        "run_number": "run_number", "timestamp": "timestamp", "ticker": "ticker", "fold": "fold",
        "cv_folds_configured": f"{cv}.n_folds_configured", "cv_folds_valid": f"{cv}.n_folds_valid",
        "cv_folds_skipped": f"{cv}.n_folds_skipped", "features_count": "features.count",
        "lstm_dims": "features.lstm_latent_dims", "train_size": f"{data}.train_size", "test_size": f"{data}.test_size",
        "accuracy": "metrics.accuracy", "auc_roc": "metrics.auc_roc", "auc_pr": "metrics.auc_pr",
        "precision": "metrics.precision", "recall": "metrics.recall", "f1": "metrics.f1_score",
        **{c: f"{fin}.{c}" for c in ("sharpe_ratio", "net_sharpe", "max_drawdown", "total_return", "net_return", "turnover")},
        **{c: c for c in (
            "coverage_ratio", "trade_coverage", "n_long_signals_raw", "n_long_signals_post_filters", "ev_mean_fold",
            "calibration_error", "recommendation_quality",
        )},
        "buy_signals": "predictions.buy_signals", "sell_signals": "predictions.sell_signals",
    }
    return records.select(*[F.col(path).alias(name) for name, path in paths.items()])


def write_csv(flat: DataFrame, path: str) -> None:
    flat.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def metadata(records: DataFrame) -> DataFrame:
    """Best, average and (population) variance over all runs; missing Sharpe ratios are left out."""
    auc, accuracy = F.col("metrics.auc_roc"), F.col("metrics.accuracy")
    sharpe, net = finite("financial_metrics.sharpe_ratio"), finite("financial_metrics.net_sharpe")
    return records.agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.greatest(F.max(auc), F.lit(0.0)).alias("best_auc"), F.greatest(F.max(accuracy), F.lit(0.0)).alias("best_accuracy"),
        F.max(sharpe).alias("best_sharpe"), F.max(net).alias("best_net_sharpe"),
        F.avg(auc).alias("average_auc"), F.avg(accuracy).alias("average_accuracy"),
        F.coalesce(F.avg(sharpe), F.lit(0.0)).alias("average_sharpe"),
        F.var_pop(auc).alias("auc_variance"), F.var_pop(accuracy).alias("accuracy_variance"),
    )


def freeze_baseline(records: DataFrame, baselines: DataFrame, tag: str, ticker: str | None = None) -> DataFrame:
    """The latest run (of a ticker) under ``tag``; no row if the tag exists or no run matches."""
    chosen = records if ticker is None else records.filter(F.upper("ticker") == ticker.upper())
    snapshot = F.struct("run_number", "ticker", "metrics", "financial_metrics", "cv")
    latest = chosen.agg(F.max_by(snapshot, "run_number").alias("s")).filter("s is not null")
    taken = baselines.filter(F.col("tag") == tag.strip()).agg(F.count(F.lit(1)).alias("n")).scalar()
    return latest.select(F.lit(tag.strip()).alias("tag"), "s.*").filter((F.col("tag") != "") & (taken == 0))


def feature_usage(records: DataFrame, top: int = 20) -> DataFrame:
    """Runs using each feature and their share, the most used ones first."""
    total = records.agg(F.count(F.lit(1)).alias("n")).scalar()
    used = records.select(F.explode("features.names").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n_runs"))
    return used.select(
        "feature", "n_runs", (100 * F.col("n_runs") / total).alias("percent")
    ).orderBy(F.desc("n_runs"), "feature").limit(top)


def feature_families(records: DataFrame) -> DataFrame:
    """Different features over all runs, split into latent and technical ones."""
    names = records.select(F.explode("features.names").alias("feature")).distinct()
    return names.agg(
        F.count(F.lit(1)).alias("n_features"), F.count_if(F.contains("feature", F.lit("lstm_latent"))).alias("n_latent"),
        F.count_if(~F.contains("feature", F.lit("lstm"))).alias("n_technical"),
    )


def best_run(flat: DataFrame, metric: str = "auc_roc") -> DataFrame:
    """The run with the highest metric; the earliest one of equals."""
    if metric not in flat.columns:
        return flat.limit(0)
    return flat.filter(F.col(metric).isNotNull()).orderBy(F.desc(metric), "run_number").limit(1)


def run_statistics(flat: DataFrame, metrics: Sequence[str] = ("accuracy", "auc_roc", "sharpe_ratio")) -> DataFrame:
    """Lowest, highest, mean and deviation of each metric, one row per metric."""
    parts = [
        F.struct(
            F.lit(m).alias("metric"), F.min(m).alias("min"), F.max(m).alias("max"), F.avg(m).alias("mean"),
            F.stddev_samp(m).alias("std"),
        ) for m in metrics
    ]
    return flat.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def early_vs_recent(flat: DataFrame, metrics: Sequence[str] = ("accuracy", "auc_roc", "sharpe_ratio"), bucket_rows: int = 100_000) -> DataFrame:
    """First half of the runs against the second: mean, deviation and change in percent."""
    rows = number_rows(flat, F.expr(f"run_number div {bucket_rows}"), keys=(), order="run_number", name="_k")
    half = flat.agg(F.floor(F.count(F.lit(1)) / 2).alias("half")).scalar()
    rows = rows.withColumn("_early", F.col("_k") <= half)
    parts = []
    for m in metrics:
        early, recent = F.when(F.col("_early"), F.col(m)), F.when(~F.col("_early"), F.col(m))
        parts.append(F.struct(
            F.lit(m).alias("metric"), F.avg(early).alias("early_mean"), F.stddev_samp(early).alias("early_std"),
            F.avg(recent).alias("recent_mean"), F.stddev_samp(recent).alias("recent_std"),
            (100 * div(F.avg(recent) - F.avg(early), F.avg(early))).alias("change_percent"),
        ))
    return rows.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def signal_statistics(flat: DataFrame) -> DataFrame:
    out = []
    for side in ("buy", "sell"):
        c = f"{side}_signals"
        out += [F.sum(c).alias(f"{side}_total"), F.avg(c).alias(f"{side}_mean"), F.stddev_samp(c).alias(f"{side}_std"),
                F.min(c).alias(f"{side}_min"), F.max(c).alias(f"{side}_max")]
    return flat.agg(*out, ((F.sum("buy_signals") + 0.1) / (F.sum("sell_signals") + 0.1)).alias("buy_sell_ratio"))


def latest_runs(records: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` runs; fold counts fall back to the run's own fold number."""
    configured = F.coalesce("cv.n_folds_configured", "fold")
    valid = F.coalesce("cv.n_folds_valid", "fold")
    return records.orderBy(F.desc("run_number")).limit(n).select(
        "run_number", "date", "ticker", F.concat_ws("/", valid, configured).alias("valid_configured"),
        F.coalesce("cv.n_folds_skipped", F.greatest(configured - valid, F.lit(0))).alias("skipped"),
        "metrics.accuracy", "metrics.auc_roc", "financial_metrics.sharpe_ratio", "financial_metrics.max_drawdown",
    )


def runs_table(flat: DataFrame) -> DataFrame:
    cols = ("run_number", "ticker", "fold", "accuracy", "auc_roc", "auc_pr", "sharpe_ratio", "max_drawdown",
            "buy_signals", "sell_signals")
    return flat.select(*[c for c in cols if c in flat.columns])


def run_details(records: DataFrame, run_number: int) -> DataFrame:
    return records.filter(F.col("run_number") == run_number)


def persistent_low_importance(records: DataFrame, last: int = 5, at_least: int = 3) -> DataFrame:
    """Features removed as unimportant in at least 3 of the last 5 runs."""
    recent = records.orderBy(F.desc("run_number")).limit(last)
    names = recent.select("run_number", F.explode("features_contract.removed_by_importance").alias("feature")).distinct()
    return names.groupBy("feature").agg(F.count(F.lit(1)).alias("n_runs")).filter(F.col("n_runs") >= at_least)
