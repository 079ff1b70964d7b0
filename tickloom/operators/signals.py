"""From probabilities to sized positions, fold by fold.

All functions work on validation rows keyed by ``keys`` (ticker, fold and
whatever identifies a setting), ordered by ``rn``.  A setting can also be a
column of the same name (``target_coverage``, ``trade_ratio_floor``, ``th_min``,
``th_max``, ``percentile``), so that one job runs many settings.
"""

from __future__ import annotations

import numpy as np
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.series import ROW, clip, div, memory_rows
from tickloom.settings import Settings

KEYS = ("ticker", "fold")
YEAR = float(np.sqrt(252.0))


def setting(df: DataFrame, s: Settings, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(getattr(s, name))


def volatility_weighted(preds: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``p``: probability lowered where volatility is high among the validation rows."""
    fold = Window.partitionBy(*keys)
    vol = F.col("volatility_20")
    weight = clip(1 + (vol - F.avg(vol).over(fold)) / (F.stddev_pop(vol).over(fold) + 1e-8), 0.5, 2.5)
    return preds.withColumn("_w", weight).withColumn("p", clip(F.col("p_raw") / F.col("_w"), 0.0, 1.0)).drop("_w")


def weight_by(preds: DataFrame, weight: Column, p: str = "p_raw") -> DataFrame:
    """Second form of the adjustment: a weight given per row."""
    return preds.withColumn("p", clip(F.col(p) / (weight + 1e-8), 0.0, 1.0))


# --- thresholds ----------------------------------------------------------------------------

def pr_curve(preds: DataFrame, keys: Sequence[str] = KEYS, p: str = "p", y: str = "target") -> DataFrame:
    """Precision and recall at every distinct score; scores are counted before they are ordered."""
    steps = preds.groupBy(*keys, p).agg(F.sum(y).alias("_tp"), F.count(F.lit(1)).alias("_n"))
    down = Window.partitionBy(*keys).orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumns({
        "_tps": F.sum("_tp").over(down), "_ns": F.sum("_n").over(down),
        "_pos": F.sum("_tp").over(Window.partitionBy(*keys)),
    })
    return steps.select(
        *keys, F.col(p).alias("threshold"), (F.col("_tps") / F.col("_ns")).alias("precision"),
        div(F.col("_tps"), F.col("_pos")).alias("recall"),
    )


def best_pr_threshold(
    preds: DataFrame, keys: Sequence[str] = KEYS, metric: str = "f1", min_recall: float = 0.25,
    p: str = "p", y: str = "target",
) -> DataFrame:
    """Threshold with the best F1, or with the best precision at a recall of at least ``min_recall``.

    The reported threshold lies one score below the one its metrics belong to.
    """
    up = Window.partitionBy(*keys).orderBy("threshold")
    curve = pr_curve(preds, keys, p, y).withColumns({
        "precision": F.coalesce(F.lead("precision").over(up), F.lit(1.0)),
        "recall": F.coalesce(F.lead("recall").over(up), F.lit(0.0)),
    })
    pr, rc = F.col("precision"), F.col("recall")
    curve = curve.withColumn("f1", 2 * pr * rc / (pr + rc + 1e-9))
    point = F.struct("threshold", "precision", "recall", "f1")
    first = -F.col("threshold")
    by_f1 = F.max_by(point, F.struct(F.round("f1", 12), first))
    best = by_f1
    if metric == "precision_at_recall":
        best = F.coalesce(F.max_by(point, F.when(rc >= min_recall, F.struct(F.round("precision", 12), first))), by_f1)
    return curve.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def search_thresholds(
    preds: DataFrame, keys: Sequence[str] = KEYS, s: Settings = Settings(), p: str = "p", carry: Sequence[str] = ()
) -> DataFrame:
    """Per fold, the threshold with the best net Sharpe after penalties, and its statistics.

    Candidates are ten quantiles of the scores or a fixed grid.  A candidate with
    too few or too many trades is out; the lowest threshold wins a tie (objectives
    are compared to 12 digits, as sums have rounding noise).  ``stats`` is null
    and the threshold is the default when no candidate is left.  ``carry`` names columns that
    are constant in a fold and kept in the result.
    """
    fold = Window.partitionBy(*keys)
    if s.search_mode == "quantile":
        steps = [float(q) for q in np.linspace(0.50, 0.95, 10)]
        ths = F.array_distinct(F.percentile(p, steps).over(fold))
    else:
        ths = F.array(*[F.lit(float(t)) for t in np.arange(0.45, 0.80, 0.05)])
    tuned = ["target_coverage", "trade_ratio_floor"]
    rows = preds.select(
        *keys, ROW, "ret", *carry, F.col(p).alias("p"), ths.alias("_ths"),
        *[clip(setting(preds, s, c).cast("double"), 0.01, 1.0).alias(f"_{c}") for c in tuned],
    ).withColumn("th", F.explode("_ths")).drop("_ths")
    position = (F.col("p") >= F.col("th")).cast("double")
    order = Window.partitionBy(*keys, "th").orderBy(ROW)
    rows = rows.withColumn("_pos", position).withColumn(
        "_turn", F.abs(F.col("_pos") - F.coalesce(F.lag("_pos").over(order), F.lit(0.0)))
    ).withColumn("_ret", F.col("ret") * F.col("_pos") - F.col("_turn") * s.trade_cost)
    open_, gain = F.col("_pos") > 0, F.col("_ret")
    tried = rows.groupBy(*keys, "th").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(open_).alias("n_trades"),
        F.avg("_ret").alias("mean"), F.stddev_pop("_ret").alias("sd"), F.sum("_turn").alias("turnover"),
        F.count_if(open_ & (gain > 0)).alias("wins"), F.avg(F.when(open_, gain)).alias("avg_return"),
        *[F.first(c).alias(c) for c in [*[f"_{c}" for c in tuned], *carry]],
    )
    n, trades = F.col("n"), F.col("n_trades")
    tried = tried.withColumns({
        "trade_ratio": trades / n,
        "sharpe": F.when((trades > 0) & (F.col("sd") > 0), div(F.col("mean"), F.col("sd")) * YEAR).otherwise(0.0),
    }).withColumn("coverage_penalty", F.abs(F.col("trade_ratio") - F.col("_target_coverage")))
    objective = (
        F.col("sharpe") - max(0.0, s.turnover_penalty) * F.col("turnover") - 1.2 * F.col("coverage_penalty")
    )
    valid = (trades >= F.greatest(F.floor(n * s.min_trades_ratio), F.lit(s.search_min_trades))) & (
        F.col("trade_ratio") >= F.col("_trade_ratio_floor")
    )
    if s.conservative:
        valid = valid & (F.col("trade_ratio") <= s.max_trade_ratio)
    stats = F.struct(
        F.col("th").alias("threshold_buy"), "sharpe", objective.alias("objective_score"), "n_trades", "trade_ratio",
        "turnover", F.coalesce(div(F.col("wins"), trades), F.lit(0.0)).alias("win_rate"),
        F.coalesce("avg_return", F.lit(0.0)).alias("avg_return"), "coverage_penalty",
    )
    rank = F.when(valid, F.struct(F.round(objective, 12), -F.col("th")))
    best = tried.groupBy(*keys).agg(F.max_by(stats, rank).alias("stats"), *[F.first(c).alias(c) for c in carry])
    return best.withColumn("threshold_buy", F.coalesce("stats.threshold_buy", F.lit(s.default_buy)))


def adaptive_thresholds(df: DataFrame, s: Settings = Settings(), z: str = "vol_z", buy: str = "threshold_buy") -> DataFrame:
    """``adaptive_buy`` / ``adaptive_sell``: thresholds moved by the volatility regime."""
    shift = F.tanh(clip(F.col(z), -s.z_clip, s.z_clip) / 1.5) * s.max_shift
    return df.withColumns({
        "adaptive_buy": clip(F.col(buy) + shift, 0.50, 0.85),
        "adaptive_sell": clip(F.lit(s.default_sell) - shift, 0.15, 0.45),
    })


def smoothed_thresholds(df: DataFrame, keys: Sequence[str] = KEYS, s: Settings = Settings()) -> DataFrame:
    """Exponential smoothing of the thresholds from fold to fold, started at the defaults.

    Folds further back than a weight below the last bit of a double are left out of each sum.
    In long-only mode the sell side is not carried over, so it starts from the default each time.
    """
    alpha = min(1.0, max(0.05, s.smoothing))
    series = [k for k in keys if k != "fold"]
    order = Window.partitionBy(*series).orderBy("fold")
    keep = 1 - alpha
    if keep <= 0:
        return df.withColumns({"smooth_buy": F.col("adaptive_buy"), "smooth_sell": F.col("adaptive_sell")})
    past = order.rowsBetween(-memory_rows(keep), 0)

    def smooth(c: str, start: float) -> Column:
        return F.aggregate(F.collect_list(c).over(past), F.lit(start), lambda state, x: alpha * x + keep * state)

    sell = (
        smooth("adaptive_sell", s.default_sell) if s.trading_mode == "long_short"
        else alpha * F.col("adaptive_sell") + keep * s.default_sell
    )
    return df.withColumns({"smooth_buy": smooth("adaptive_buy", s.default_buy), "smooth_sell": sell})


def clamped_threshold(df: DataFrame, s: Settings = Settings(), c: str = "smooth_buy", out: str = "final_buy") -> DataFrame:
    """Threshold inside the conservative band; unchanged for other profiles."""
    value = F.col(c)
    if s.conservative:
        value = F.least(F.greatest(value, setting(df, s, "th_min")), setting(df, s, "th_max"))
    return df.withColumn(out, value)


def fold_thresholds(preds: DataFrame, keys: Sequence[str] = KEYS, s: Settings = Settings()) -> DataFrame:
    """Search, adapt, smooth and clamp: one row per fold."""
    fold = Window.partitionBy(*keys)
    z = (F.col("volatility_20") - F.col("train_vol_mean")) / (F.col("train_vol_std") + 1e-8)
    preds = preds.withColumns({
        "vol_z": F.avg(z).over(fold),
        "bear_ratio": F.avg((F.col("distance_to_ma200") < -0.02).cast("double")).over(fold),
    })
    band = [c for c in ("th_min", "th_max") if c in preds.columns]
    found = search_thresholds(preds, keys, s, carry=["vol_z", "bear_ratio", *band])
    return clamped_threshold(smoothed_thresholds(adaptive_thresholds(found, s), keys, s), s).drop(*band)


# --- signals -------------------------------------------------------------------------------

def _percentile(value: Column, percents: Sequence[float], chosen: Column, fold) -> Column:
    """Exact percentile whose level is a column with one of the values ``percents``."""
    levels = sorted(set(percents))
    found = F.percentile(value, [q / 100 for q in levels]).over(fold)
    place = F.array_position(F.array(*[F.lit(float(q)) for q in levels]), chosen.cast("double"))
    return F.get(found, place.cast("int") - 1)


def technical_filter(df: DataFrame, keys: Sequence[str] = KEYS) -> Column:
    """Volatility and range not in the lowest tenth, price not far below its long mean.

    All three columns must be there: a missing one would turn its leg off without a word.
    """
    missing = {"volatility_20", "atr", "distance_to_ma200"} - set(df.columns)
    if missing:
        raise ValueError(f"the technical filter needs {sorted(missing)}")
    fold = Window.partitionBy(*keys)
    ok = F.col("distance_to_ma200") > -0.02
    for c in ("volatility_20", "atr"):
        ok = ok & (F.col(c) >= F.percentile(c, 0.1).over(fold))
    return F.coalesce(ok, F.lit(False))


def threshold_signal(df: DataFrame, threshold: Column, out: str = "signal", p: str = "p") -> DataFrame:
    return df.withColumn(out, (F.col(p) >= threshold).cast("int"))


def percentile_signal(df: DataFrame, keys: Sequence[str] = KEYS, percent: float = 80.0, out: str = "signal", p: str = "p") -> DataFrame:
    """Signal for the rows at or above a percentile of the fold's probabilities."""
    cut = F.percentile(p, percent / 100).over(Window.partitionBy(*keys))
    return df.withColumn(out, (F.col(p) >= cut).cast("int"))


def short_leg(df: DataFrame, threshold: Column, signal: str = "signal", p: str = "p") -> DataFrame:
    return df.withColumn(signal, F.when(F.col(p) <= threshold, -1).otherwise(F.col(signal)))


def hybrid_signal(
    df: DataFrame, threshold: Column, keys: Sequence[str] = KEYS, percent: Column | float = 60.0,
    percents: Sequence[float] = (60.0,), technical: str | None = None, tag: str = "", p: str = "p",
) -> DataFrame:
    """Above the threshold, in the top part of those, and technically sound.

    Adds ``signal``, and the row's cause of rejection as ``rejected`` (threshold,
    percentile, technical or null), both with ``tag`` appended.
    """
    fold = Window.partitionBy(*keys)
    percent = percent if isinstance(percent, Column) else F.lit(float(percent))
    df = df.withColumn("_high", F.col(p) >= threshold)
    df = df.withColumn("_cut", _percentile(F.when(F.col("_high"), F.col(p)), percents, percent, fold))
    top = F.col("_high") & F.coalesce(F.col(p) >= F.col("_cut"), F.lit(False))
    sound = F.col(technical) if technical else F.lit(True)
    return df.withColumns({
        f"signal{tag}": (top & sound).cast("int"),
        f"rejected{tag}": F.when(~F.col("_high"), "threshold").when(~top, "percentile").when(~sound, "technical"),
    }).drop("_high", "_cut")


def relaxed_signals(
    preds: DataFrame, keys: Sequence[str] = KEYS, s: Settings = Settings(), percents: Sequence[float] | None = None
) -> DataFrame:
    """Hybrid signals at ``final_buy``, lowered by .02 and then .01 while the fold trades too little.

    The three thresholds are evaluated side by side on the fold's rows and one is
    chosen per fold; ``relaxed`` counts the steps taken.
    """
    fold = Window.partitionBy(*keys)
    default_percent = s.percentile if s.conservative else s.balanced_percentile
    percent = setting(preds, s, "percentile") if s.conservative else F.lit(default_percent)
    percents = tuple(percents or (default_percent,))
    least = setting(preds, s, "th_min") if s.conservative else F.lit(0.50)
    floor = F.greatest(setting(preds, s, "trade_ratio_floor"), F.lit(s.min_trades_ratio))
    df = preds.withColumns({
        "_sound": technical_filter(preds, keys),
        "_t0": F.col("final_buy"),
        "_t1": F.greatest(least, F.col("final_buy") - 0.02),
    }).withColumn("_t2", F.greatest(least, F.col("_t1") - 0.01))
    for k in (0, 1, 2):
        df = hybrid_signal(df, F.col(f"_t{k}"), keys, percent, percents, "_sound", tag=str(k))
    df = df.withColumns({f"_r{k}": F.avg(F.col(f"signal{k}").cast("double")).over(fold) for k in (0, 1)})
    if s.trading_mode == "long_only":
        one = (F.col("_r0") < floor) & (F.col("_t1") < F.col("_t0"))
        two = one & (F.col("_r1") < floor) & (F.col("_t2") < F.col("_t1"))
    else:
        one = two = F.lit(False)
    df = df.withColumn("relaxed", F.when(two, 2).when(one, 1).otherwise(0))

    def chosen(name: str) -> Column:
        return F.when(F.col("relaxed") == 2, F.col(f"{name}2")).when(F.col("relaxed") == 1, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))

    df = df.withColumns({"signal": chosen("signal"), "rejected": chosen("rejected"), "used_buy": chosen("_t")})
    if s.trading_mode == "long_short":
        df = short_leg(df, F.col("smooth_sell"))
    return df.drop(*[f"{n}{k}" for n in ("signal", "rejected", "_t", "_r") for k in (0, 1, 2)], "_sound")


def regime_gate(df: DataFrame, s: Settings = Settings()) -> DataFrame:
    """No entries at all in a fold of extreme volatility far below the long mean (``gated``)."""
    gate = (F.col("vol_z") >= s.gate_vol_z) & (F.col("bear_ratio") >= s.gate_bear_ratio)
    return df.withColumn("gated", F.coalesce(gate, F.lit(False))).withColumn(
        "gate_cut", F.when(F.col("gated") & (F.col("signal") == 1), 1).otherwise(0)
    ).withColumn("signal", F.when(F.col("gated"), 0).otherwise(F.col("signal")))


def capped_entries(df: DataFrame, keys: Sequence[str] = KEYS, s: Settings = Settings(), p: str = "p") -> DataFrame:
    """Keep the most probable entries, at most a fixed share of the fold's rows (at least one).

    This limit is the feature: it bounds turnover in the conservative profile.
    """
    rank = F.row_number().over(Window.partitionBy(*keys, "signal").orderBy(F.desc(p), F.desc(ROW)))
    most = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(Window.partitionBy(*keys)) * s.max_trade_ratio))
    over = (F.col("signal") == 1) & (F.col("_rank") > F.col("_most"))
    return df.withColumns({"_rank": rank, "_most": most}).withColumns({
        "cap_cut": over.cast("int"), "signal": F.when(over, 0).otherwise(F.col("signal")),
    }).drop("_rank", "_most")


def position_sizes(df: DataFrame, s: Settings = Settings(), threshold: str = "used_buy", p: str = "p") -> DataFrame:
    """Size by distance from the threshold, reduced in volatile regimes; 0 when uncertain."""
    confidence = s.conservative_confidence if s.conservative else s.size_min_confidence
    band = s.conservative_band if s.conservative else s.size_band
    penalty = s.size_vol_penalty * (s.conservative_penalty_mult if s.conservative else 1.0)
    buy, prob, t = F.col("signal") == 1, F.col(p), F.col(threshold)
    share = clip((prob - t) / (1 - t + 1e-9), 0.0, 1.0)
    regime = clip(1 - penalty * F.greatest(F.lit(0.0), F.col("vol_z")) / 2, 0.25, 1.0)
    uncertain, unsure = F.abs(prob - 0.5) < band, prob < confidence
    size = F.when(buy & ~uncertain & ~unsure, clip(share * regime, 0.0, s.size_max)).otherwise(0.0)
    return df.withColumns({
        "size": size,
        "skipped_uncertain": (buy & uncertain).cast("int"),
        "skipped_low_confidence": (buy & unsure).cast("int"),
    })


def sizing_summary(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    sized = F.col("size") > 0
    return df.groupBy(*keys).agg(
        F.count_if(F.col("signal") == 1).alias("n_candidates"), F.sum("skipped_uncertain").alias("n_skipped_uncertain"),
        F.sum("skipped_low_confidence").alias("n_skipped_low_conf"), F.count_if(sized).alias("n_sized"),
        F.coalesce(F.avg(F.when(sized, F.col("size"))), F.lit(0.0)).alias("avg_size"),
    )


def rejection_aggregates() -> list[Column]:
    """How many rows each filter turned away."""
    cause = F.col("rejected")
    return [
        F.count_if(cause == "threshold").alias("threshold_rejected"),
        F.count_if(cause == "percentile").alias("percentile_rejected"),
        F.count_if(cause == "technical").alias("technical_rejected"),
        F.count_if(F.col("p") >= F.col("used_buy")).alias("raw_buy_candidates"),
        F.sum(F.col("gate_cut") + F.col("cap_cut")).alias("regime_gate_rejected"),
        F.sum(F.col("skipped_uncertain") + F.col("skipped_low_confidence")).alias("confidence_rejected"),
        F.count_if(F.col("signal") == 1).alias("post_filters_buy_signals"),
        F.max("relaxed").alias("threshold_relaxed"),
    ]


def rejection_counts(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(*rejection_aggregates())


def open_positions(
    preds: DataFrame, thresholds: DataFrame, keys: Sequence[str] = KEYS, s: Settings = Settings(),
    percents: Sequence[float] | None = None,
) -> DataFrame:
    """Signals, gate, cap and size for every validation row."""
    df = regime_gate(relaxed_signals(preds.join(thresholds, list(keys)), keys, s, percents), s)
    if s.conservative and s.trading_mode == "long_only":
        df = capped_entries(df, keys, s)
    else:
        df = df.withColumn("cap_cut", F.lit(0))
    return position_sizes(df, s)


def signal_counts(preds: DataFrame, keys: Sequence[str] = ("ticker",), trading_mode: str = "long_only") -> DataFrame:
    """Buy, sell and hold rows by fixed bounds on the probability before the volatility adjustment."""
    p = F.col("p_raw")
    sell = F.count_if(p < 0.35) if trading_mode == "long_short" else F.lit(0).cast("long")
    return preds.groupBy(*keys).agg(
        F.count_if(p > 0.65).alias("buy_signals"), sell.alias("sell_signals"), F.count_if(p.between(0.35, 0.65)).alias("hold_signals"),
    )


def signal_marks(preds: DataFrame, p: str = "p_raw") -> DataFrame:
    """Rows a report marks as buy or sell, with the price."""
    mark = F.when(F.col(p) > 0.65, "BUY").when(F.col(p) < 0.35, "SELL")
    return preds.withColumn("mark", mark).filter(F.col("mark").isNotNull())
