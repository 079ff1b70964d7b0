"""From fold probabilities and the last bar to one decision per ticker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.metrics import expected_value
from tickloom.functions.series import ROW, clip, div
from tickloom.settings import PROFILE_THRESHOLD, RISK_TYPE, Settings


def latest_fold_probability(preds: DataFrame, last_dates: DataFrame, p: str = "p_raw") -> DataFrame:
    """Uncalibrated score of the last validation row of each fold, dated with the table's last day."""
    latest = preds.groupBy("ticker", "fold").agg(F.max_by(p, ROW).alias("probability"))
    return latest.join(last_dates.select("ticker", "last_date"), "ticker")


def ensemble_summary(future: DataFrame, tickers: DataFrame) -> DataFrame:
    """Mean, highest and lowest fold probability; .5 for a ticker without a fold."""
    spread = F.col("max_prob") - F.col("min_prob")
    per = future.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_models"), F.avg("probability").alias("avg_prob"),
        F.max("probability").alias("max_prob"), F.min("probability").alias("min_prob"),
        clip(1 - 4 * F.stddev_pop("probability"), 0.0, 1.0).alias("recommendation_quality"),
    )
    return (
        tickers.select("ticker").join(per, "ticker", "left")
        .fillna({"n_models": 0, "avg_prob": 0.5, "max_prob": 0.5, "min_prob": 0.5})
        .withColumn("spread", spread)
        .withColumn("consensus", F.when(spread < 0.1, "High").when(spread < 0.2, "Moderate").otherwise("Low"))
    )


def latest_bar(df: DataFrame, metric: str = "volatility_20") -> DataFrame:
    """Last close and date, and the last known volatility (with the name of its measure)."""
    known = F.when(F.col(metric).isNotNull(), F.col(ROW))
    return df.groupBy("ticker").agg(
        F.max_by("close", ROW).alias("last_price"), F.max("date").alias("last_date"),
        F.max_by(metric, known).alias("volatility"),
    ).withColumn("vol_metric", F.lit("atr_14d" if metric == "atr" else "rolling_std_20d"))


def decide(
    p: Column, threshold: Column, tp: Column, sl: Column, cost: Column | float, allowed: Column | None = None,
    min_margin: float = 0.0,
) -> Column:
    """Struct (state, expected_value, quality, reason) for one probability and risk setting."""
    ev = expected_value(p, tp, sl, cost)
    allowed = F.lit(True) if allowed is None else allowed
    quality = clip((p - threshold) / F.greatest(F.lit(1e-6), 1 - threshold), 0.0, 1.0)
    weak = F.greatest(F.lit(0.0), p - 0.5)

    def outcome(state: str, q: Column, reason: str) -> Column:
        return F.struct(
            F.lit(state).alias("state"), ev.alias("expected_value"), q.cast("double").alias("quality"), F.lit(reason).alias("reason")
        )

    return (
        F.when(~allowed, outcome("NO_TRADE", F.lit(0.0), "blocked_by_regime"))
        .when(ev <= min_margin, outcome("WATCHLIST", weak, "non_positive_ev"))
        .when(p < threshold, outcome("WATCHLIST", weak, "below_dynamic_threshold"))
        .when(quality >= 0.7, outcome("ENTER_FULL", quality, "high_confidence_positive_ev"))
        .when(quality >= 0.35, outcome("ENTER_SMALL", quality, "moderate_confidence_positive_ev"))
        .otherwise(outcome("WATCHLIST", quality, "low_margin_positive_ev"))
    )


def advice(p: Column) -> Column:
    return F.when(p > 0.65, "BUY").when(p < 0.35, "AVOID").otherwise("HOLD")


def with_risk_levels(df: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Target and stop at ``k`` volatilities from the last price, also as fractions of it."""
    price = F.greatest(F.lit(1e-9), F.col("last_price"))
    return df.withColumns({
        "profit_target": F.col("last_price") + F.col("volatility") * s.k_tp,
        "stop_loss": F.col("last_price") - F.col("volatility") * s.k_sl,
    }).withColumns({
        "tp_pct": (F.col("profit_target") - F.col("last_price")) / price,
        "sl_pct": (F.col("stop_loss") - F.col("last_price")) / price,
    })


def recommend(ensemble: DataFrame, last: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per ticker: levels, decision, advice."""
    df = with_risk_levels(ensemble.join(last, "ticker"), s)
    decision = decide(
        F.col("avg_prob"), F.lit(PROFILE_THRESHOLD.get(s.risk_profile, 0.68)), F.col("tp_pct"), F.col("sl_pct"),
        s.trade_cost, min_margin=0.001 if s.conservative else 0.0,
    )
    return df.withColumn("_d", decision).select("*", "_d.*", advice(F.col("avg_prob")).alias("advice")).drop("_d")


def payload(df: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The recommendation as one JSON text per ticker."""
    risk = F.struct(
        F.lit(RISK_TYPE).alias("type"),
        F.struct(F.lit(s.k_tp).alias("k_tp"), F.lit(s.k_sl).alias("k_sl"), F.col("vol_metric").alias("vol_metric")).alias("params"),
    )
    body = F.struct(
        F.col("last_price").alias("entry"), "profit_target", "stop_loss", F.col("avg_prob").alias("probability"),
        risk.alias("dynamic_risk"),
    )
    return df.select(
        "ticker", F.to_json(body).alias("payload"),
        F.coalesce(100 * div(F.col("profit_target") - F.col("last_price"), F.col("last_price")), F.lit(0.0)).alias("target_pct"),
        F.coalesce(100 * div(F.col("stop_loss") - F.col("last_price"), F.col("last_price")), F.lit(0.0)).alias("stop_pct"),
    )


def forecast_ladder(levels: DataFrame, p: str = "avg_prob", horizon: int = 20) -> DataFrame:
    """Expected price for each of the next days, and the fading probability.

    The price moves towards the target (p > .5) or the stop along 1 - exp(-3 h/horizon);
    the probability falls linearly by a tenth of itself.
    """
    prob, h = F.col(p), F.col("h")
    goal = F.when(prob > 0.5, F.col("profit_target")).otherwise(F.col("stop_loss"))
    change = div(goal - F.col("last_price"), F.col("last_price"))
    bias = 0.5 + 0.5 * (2 * F.abs(prob - 0.5))
    curve = 1 - F.exp(-3 * h / horizon)
    fade = prob * 0.1 * (h - 1) / max(1, horizon - 1)
    return levels.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).select(
        "ticker", "h", F.date_add("last_date", F.col("h")).alias("date"),
        (F.col("last_price") * (1 + change * curve * bias)).alias("forecast_price"),
        clip(prob - fade, 0.0, 1.0).alias("forecast_probability"),
    )


