"""Quality of probabilities: ranking, calibration, and the market of a fold."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.metrics import brier, share
from tickloom.functions.series import div

KEYS = ("ticker", "fold")


def roc_auc(df: DataFrame, keys: Sequence[str] = KEYS, p: str = "p", y: str = "target") -> DataFrame:
    """Area under the ROC curve with ties at half weight; null with one class.

    Scores are counted first, so the ordered pass sees one row per distinct score.
    """
    counts = df.groupBy(*keys, p).agg(
        F.sum(y).alias("_pos"), F.sum(1 - F.col(y)).alias("_neg")
    )
    below = Window.partitionBy(*keys).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("_pos") * (F.coalesce(F.sum("_neg").over(below), F.lit(0.0)) + F.col("_neg") / 2)
    return counts.withColumn("_won", won).groupBy(*keys).agg(
        div(F.sum("_won"), F.sum("_pos") * F.sum("_neg")).alias("auc")
    )


def average_precision(df: DataFrame, keys: Sequence[str] = KEYS, p: str = "p", y: str = "target") -> DataFrame:
    """Sum over distinct scores of precision times the step in recall."""
    counts = df.groupBy(*keys, p).agg(F.sum(y).alias("_pos"), F.count(F.lit(1)).alias("_n"))
    down = Window.partitionBy(*keys).orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    step = F.col("_pos") * F.sum("_pos").over(down) / F.sum("_n").over(down)
    return counts.withColumn("_step", step).groupBy(*keys).agg(div(F.sum("_step"), F.sum("_pos")).alias("aucpr"))


def calibration_error(
    df: DataFrame, keys: Sequence[str] = KEYS, p: str = "p", y: str = "target", bins: int = 10
) -> DataFrame:
    """Expected calibration error over equal bins (upper edge open, last bin closed)."""
    edges = [float(e) for e in np.linspace(0.0, 1.0, bins + 1)]
    # Compared with the edges themselves: floor(p * bins) puts 0.3 into the wrong bin.
    place = F.lit(0)
    for edge in edges[1:-1]:
        place = place + (F.col(p) >= edge).cast("int")
    inside = F.col(p).between(edges[0], edges[-1])
    per_bin = df.withColumn("_bin", F.when(inside, place)).groupBy(*keys, "_bin").agg(
        F.count(F.lit(1)).alias("_n"), F.abs(F.avg(y) - F.avg(p)).alias("_gap")
    )
    used = F.when(F.col("_bin").isNotNull(), F.col("_gap") * F.col("_n"))
    return per_bin.groupBy(*keys).agg((F.coalesce(F.sum(used), F.lit(0.0)) / F.sum("_n")).alias("ece"))


def brier_score(df: DataFrame, keys: Sequence[str] = KEYS, p: str = "p", y: str = "target") -> DataFrame:
    return df.groupBy(*keys).agg(brier(F.col(y), F.col(p)).alias("brier"))


def market_conditions(members: DataFrame, sized: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Regime of every fold: classes, volatility against training, trend, undecided scores, trades.

    ``sized`` holds the validation rows with ``p``, ``signal`` and ``size``.
    """
    vol = F.col("volatility_20")
    train = members.filter(F.col("role") == "train").groupBy(*keys).agg(
        F.avg(vol).alias("_m"), (F.stddev_pop(vol) + 1e-9).alias("_s")
    )
    z = (vol - F.col("_m")) / F.col("_s")
    dist, p = F.col("distance_to_ma200"), F.col("p")
    return sized.join(train, list(keys)).groupBy(*keys).agg(
        share(F.col("target") == 1).alias("buy_share"), share(F.col("target") == 0).alias("sell_share"),
        F.avg(z).alias("val_vol_zscore_mean"), F.stddev_pop(z).alias("val_vol_zscore_std"),
        F.avg(dist).alias("distance_to_ma200_mean"), share(dist < -0.02).alias("pct_below_ma200_gt_2pct"),
        share(p.between(0.45, 0.55)).alias("signal_midzone_ratio"), F.avg(p).alias("mean_probability"),
        F.stddev_pop(p).alias("std_probability"), F.count_if(F.col("signal") == 1).alias("opened_positions"),
        F.count_if(F.col("size") > 0).alias("sized_positions"),
    )


def high_volatility(members: DataFrame, limit: float = 1.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """``high_vol``: row of the upper volatility regime, by the stored z-score or against the training rows."""
    if "rolling_volatility_zscore" in members.columns:
        z: Column = F.col("rolling_volatility_zscore")
    else:
        vol, fold = F.col("volatility_20"), Window.partitionBy(*keys)
        train = F.when(F.col("role") == "train", vol)
        z = (vol - F.avg(train).over(fold)) / (F.stddev_pop(train).over(fold) + 1e-9)
    return members.withColumn("high_vol", F.coalesce(z > limit, F.lit(False)))
