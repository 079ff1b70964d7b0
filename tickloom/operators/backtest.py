"""Returns of sized positions net of costs, per fold and over folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.metrics import precision_recall, ratio, share, sharpe
from tickloom.functions.series import ROW, clip, div
from tickloom.operators.signals import rejection_aggregates
from tickloom.settings import Settings

KEYS = ("ticker", "fold")


def with_costs(df: DataFrame, keys: Sequence[str] = KEYS, s: Settings = Settings(), size: str = "size") -> DataFrame:
    """``turnover``, ``gross`` and ``net`` return per row; a fold starts without a position."""
    order = Window.partitionBy(*keys).orderBy(ROW)
    turnover = F.abs(F.col(size) - F.lag(size, 1, 0.0).over(order))
    return df.withColumn("turnover", turnover).withColumns({
        "gross": F.col("ret") * F.col(size),
        "net": F.col("ret") * F.col(size) - F.col("turnover") * s.trade_cost,
    })


def drawdown(df: DataFrame, returns: str, keys: Sequence[str] = KEYS, out: str = "drawdown") -> DataFrame:
    """Fall of the compounded value below its running peak, per row (a fold is a bounded group)."""
    past = Window.partitionBy(*keys).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    # A product, not a sum of logarithms: a return of -1 or below must stay in it.
    value = F.product(1 + F.col(returns)).over(past)
    return df.withColumn("_value", value).withColumn(
        out, F.col("_value") / F.max("_value").over(past) - 1
    ).drop("_value")


def net_metrics(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(
        sharpe(F.col("net")).alias("net_sharpe"), F.sum("net").alias("net_return"), F.sum("turnover").alias("turnover"),
    )


def expected_values(df: DataFrame, keys: Sequence[str] = KEYS, s: Settings = Settings()) -> DataFrame:
    """``ev`` per row; the unit of target and stop is the deviation of the fold's returns."""
    unit = F.stddev_pop("ret").over(Window.partitionBy(*keys))
    tp, sl = clip(F.col("_u") * s.k_tp, 0.0, 0.25), clip(F.col("_u") * s.k_sl, 0.0, 0.25)
    value = F.col("p") * tp - (1 - F.col("p")) * sl - s.trade_cost
    return df.withColumn("_u", unit).withColumn("ev", value).drop("_u")


def fold_results(sized: DataFrame, keys: Sequence[str] = KEYS, s: Settings = Settings()) -> DataFrame:
    """One row per fold with its scores, returns, trades and filter counts.

    Everything row-wise is a window over the fold, so one exchange and one aggregation give
    the whole row (the ranking measures are also kept as operators of their own).  Folds below
    ``min_trades`` positions keep their row, with ``reason`` set.
    """
    y, signal, size = F.col("target"), F.col("signal"), F.col("size")
    down = Window.partitionBy(*keys).orderBy(F.desc("p")).rangeBetween(Window.unboundedPreceding, 0)
    df = sized.withColumns({
        "_pred": (F.col("p") >= 0.5).cast("int"),
        "_rank": F.rank().over(Window.partitionBy(*keys).orderBy("p"))
        + (F.count(F.lit(1)).over(Window.partitionBy(*keys, "p")) - 1) / 2,
        "_precision": F.sum("target").over(down) / F.count(F.lit(1)).over(down),
    })
    df = expected_values(drawdown(with_costs(df, keys, s), "gross", keys), keys, s)
    raw = F.col("ret") * F.col("_pred")
    hit = ((signal == 1) & (y == 1)).cast("int")
    precision, recall, f1 = precision_recall(hit, (signal == 1).cast("int"), (y == 1).cast("int"))
    trades, pos, neg = F.count_if(size > 0), F.sum("target"), F.sum(1 - y)
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_val"),
        F.first("n_train").alias("n_train"),
        div(F.sum(F.when(y == 1, F.col("_rank"))) - pos * (pos + 1) / 2, pos * neg).alias("auc"),
        F.avg(F.when(y == 1, F.col("_precision"))).alias("aucpr"),
        share(F.col("_pred") == y).alias("accuracy"),
        share(signal == y).alias("accuracy_thresholded"),
        F.when(F.sum("_pred") >= 3, sharpe(raw)).alias("sharpe"),
        F.when(trades >= 3, sharpe(F.col("gross"))).alias("sharpe_thresholded"),
        F.when(trades >= 3, F.least(F.min("drawdown"), F.lit(0.0))).alias("max_drawdown"),
        precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
        F.first("used_buy").alias("threshold_buy"),
        F.sum("gross").alias("fold_total_return"),
        F.sum("net").alias("net_return"), sharpe(F.col("net")).alias("net_sharpe"), F.sum("turnover").alias("turnover"),
        ratio(F.count_if(F.col("net") > 0), trades).alias("fold_win_rate"),
        F.count_if(F.col("gross") > 0).alias("winning_days"),
        F.count_if((size > 0) & (y == 1)).alias("wins"),
        F.count_if((size > 0) & (y == 0)).alias("losses"),
        F.count_if((signal == 0) & (y == 0)).alias("avoided_losses"),
        trades.alias("fold_trades"),
        share(size > 0).alias("trade_coverage"),
        F.when(trades > 0, F.avg(F.when(signal == 1, F.col("ev")))).otherwise(F.avg("ev")).alias("ev_mean_fold"),
        F.first("stats.n_trades").alias("_n_at"), F.first("stats.trade_ratio").alias("_ratio_at"),
        *rejection_aggregates(),
    )
    return out.withColumns({
        "n_trades_at_threshold": F.coalesce("_n_at", "fold_trades"),
        "trade_ratio_at_threshold": F.coalesce("_ratio_at", "trade_coverage"),
        "threshold_sell": F.lit(None).cast("double"),
        "reason": F.when(F.col("fold_trades") < s.min_trades, "insufficient_trades"),
    }).drop("_n_at", "_ratio_at")


def fold_accounting(
    results: DataFrame, skipped: DataFrame, keys: Sequence[str] = ("ticker",)
) -> DataFrame:
    """Valid and skipped folds with the reasons; ``skipped`` holds (keys, fold, reason)."""
    valid = results.select(*keys, "fold", F.lit(None).cast("string").alias("reason"))
    rows = valid.unionByName(skipped.select(*keys, "fold", "reason"))
    return rows.groupBy(*keys).agg(
        F.count_if(F.col("reason").isNull()).alias("n_folds_valid"),
        F.count_if(F.col("reason").isNotNull()).alias("n_folds_skipped"),
        F.count(F.lit(1)).alias("n_folds_total"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("fold", "reason")))),
            lambda x: x["reason"],
        ).alias("skip_reasons"),
    )


def cross_fold_metrics(results: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Run metrics over the valid folds (rows with a ``reason`` only count as configured).

    A run without a valid fold keeps its row, with coverage 0 and no averages.
    """
    ok = F.col("reason").isNull()

    def over(fn, c: str) -> Column:
        return fn(F.when(ok, F.col(c)))

    n_valid, n_all = F.count_if(ok), F.count(F.lit(1))
    averages = {
        "accuracy": "accuracy", "precision": "precision", "recall": "recall", "f1": "f1", "auc": "auc",
        "aucpr": "auc_pr", "sharpe_thresholded": "sharpe_thresholded_mean", "threshold_buy": "threshold_buy_mean",
        "sharpe": "sharpe_ratio", "net_sharpe": "net_sharpe", "max_drawdown": "max_drawdown",
        "trade_coverage": "trade_coverage", "ev_mean_fold": "ev_mean_fold",
    }
    spreads = {"accuracy": "accuracy_std", "auc": "auc_std", "aucpr": "auc_pr_std", "sharpe_thresholded": "sharpe_thresholded_std"}
    totals = {
        "fold_total_return": "total_return", "net_return": "net_return", "turnover": "turnover",
        "raw_buy_candidates": "n_long_signals_raw", "fold_trades": "n_long_signals_post_filters", "n_val": "test_size",
    }
    return results.groupBy(*keys).agg(
        n_valid.alias("n_folds_valid"), n_all.alias("n_folds_configured"), (n_all - n_valid).alias("n_folds_skipped"),
        (n_valid / n_all).alias("coverage_ratio"),
        *[over(F.avg, c).alias(name) for c, name in averages.items()],
        *[over(F.stddev_samp, c).alias(name) for c, name in spreads.items()],
        *[over(F.sum, c).alias(name) for c, name in totals.items()],
        over(F.min, "fold_trades").alias("min_fold_trades"), over(F.median, "fold_trades").alias("median_fold_trades"),
        over(F.min, "auc").alias("worst_fold_auc"), over(F.min, "aucpr").alias("worst_fold_aucpr"),
        F.max(F.when(ok, F.col("n_train"))).alias("train_size"),
        ratio(over(F.sum, "winning_days"), over(F.sum, "fold_trades")).alias("win_rate"),
    )


def calibration_summary(results: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Whether any fold was calibrated, the most frequent method, mean error and Brier score."""
    return results.groupBy(*keys).agg(
        F.bool_or("calibration_enabled").alias("calibration_enabled"),
        F.mode("calibration_method", True).alias("calibration_method"),
        F.avg("calibration_error").alias("calibration_error"), F.avg("brier").alias("brier"),
    )


def strategy_curve(preds: DataFrame, keys: Sequence[str] = KEYS, p: str = "p_raw") -> DataFrame:
    """Cumulative percent return of going long above .55 and short below .45, beside holding.

    ``bar_return`` is the percent return of the row's own bar against the bar before it;
    a decision earns that of the next row of the fold.
    """
    order = Window.partitionBy(*keys).orderBy(ROW)
    past = order.rowsBetween(Window.unboundedPreceding, 0)
    following = F.lead("bar_return").over(order)
    earned = F.when(F.col(p) > 0.55, following).when(F.col(p) < 0.45, -following).otherwise(0.0)
    return preds.withColumn("strategy_return", F.coalesce(earned, F.lit(0.0))).withColumns({
        "cum_strategy": F.sum("strategy_return").over(past), "cum_hold": F.sum("bar_return").over(past),
    })
