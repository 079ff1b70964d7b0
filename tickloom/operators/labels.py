"""Barrier labels: which price level is reached first after a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.series import CHUNK, KEY, ROW, Layout, carry_in, roll
from tickloom.settings import LABEL_DOWN, LABEL_HORIZON, LABEL_UP, RISK_TYPE, Settings


def volatility_barriers(
    df: DataFrame, layout: Layout = Layout(), up: float = LABEL_UP, down: float = LABEL_DOWN,
    horizon: int = LABEL_HORIZON, metric: str = "volatility_20", settings: Settings = Settings(),
) -> DataFrame:
    """Label 1 if ``close + up * vol`` is reached first in the next ``horizon`` rows, 0 for
    ``close - down * vol`` (also when both fall on one row), null for neither or too few rows.

    ``metric`` is ``volatility_20`` or ``atr``; without such a column the 20-row deviation of the
    close is taken.  Gaps take the last, then the next known value: from the rows of the chunk,
    else from the carry of the chunks around it.  All of it runs on one layout of the rows.
    """
    w = Layout.window()
    stored = metric in df.columns
    rows = layout.spread(df, before=0 if stored else 20, after=horizon).withColumn(
        "_vol", F.col(metric).cast("double") if stored else roll(F.stddev_samp, F.col("close"), 20, w)
    )
    carry = carry_in(rows.filter("core"), [KEY], CHUNK, ROW, lasts=["_vol"], nexts=["_vol"])
    ahead = w.rowsBetween(1, horizon)
    rows = rows.withColumns({
        "_prev": F.last("_vol", True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_next": F.first("_vol", True).over(w.rowsBetween(0, Window.unboundedFollowing)),
        "_highs": F.collect_list("high").over(ahead),
        "_lows": F.collect_list("low").over(ahead),
    })
    vol = F.coalesce("_vol", "_prev", "_vol_before", "_next", "_vol_after")
    rows = Layout.core(rows.join(carry, [KEY, CHUNK])).withColumns({
        "barrier_up": F.col("close") + up * vol, "barrier_down": F.col("close") - down * vol,
    })
    rows = rows.withColumns({
        "_u": F.array_position(F.transform("_highs", lambda x: x >= F.col("barrier_up")), True),
        "_d": F.array_position(F.transform("_lows", lambda x: x <= F.col("barrier_down")), True),
    })
    u, d = F.col("_u"), F.col("_d")
    target = (
        F.when((F.size("_highs") < horizon) | ((u == 0) & (d == 0)), F.lit(None).cast("double"))
        .when((d == 0) | ((u > 0) & (u < d)), 1.0)
        .otherwise(0.0)
    )
    return rows.withColumn("target", target).select(*df.columns, "barrier_up", "barrier_down", "target").withColumns({
        "dynamic_risk_type": F.lit(RISK_TYPE),
        "dynamic_risk_k_tp": F.lit(settings.k_tp),
        "dynamic_risk_k_sl": F.lit(settings.k_sl),
        "dynamic_risk_vol_metric": F.lit("atr_14d" if metric == "atr" else "rolling_std_20d"),
    })


def _sign(value: Column) -> Column:
    return F.when(value > 0, 1).when(value < 0, -1).otherwise(0)


def percent_barriers(
    df: DataFrame, layout: Layout = Layout(), profit: float = 0.01, stop: float = 0.005, days: int = 10
) -> DataFrame:
    """Label 1 / -1 for the first close at the profit / stop level within ``days`` calendar days.

    The first close after the time limit decides by its direction; a series that
    ends before that gives 0.  Days are distinct per ticker, so the limit is at
    most ``days`` rows away and the frame needs one row more.
    """
    w = Layout.window()
    df = layout.spread(df, after=days + 1).withColumn(
        "_next", F.collect_list(F.struct("date", "close")).over(w.rowsBetween(1, days + 1))
    )
    entry, limit = F.col("close"), F.date_add("date", days)

    def late(x: Column) -> Column:
        return x["date"] > limit

    def hit(x: Column) -> Column:
        return late(x) | (x["close"] >= entry * (1 + profit)) | (x["close"] <= entry * (1 - stop))

    first = F.get(F.filter("_next", hit), F.lit(0))
    label = (
        F.when(first.isNull(), 0)
        .when(late(first), _sign(first["close"] - entry))
        .when(first["close"] >= entry * (1 + profit), 1)
        .otherwise(-1)
    )
    return Layout.core(df.withColumn("label", label).drop("_next"))


def percent_barriers_any(
    df: DataFrame, layout: Layout = Layout(), profit: float = 0.01, stop: float = 0.005, days: int = 10
) -> DataFrame:
    """Like ``percent_barriers`` with other rules: any profit level in the next ``5 * days - 1``
    rows wins over any stop level, the time limit is used only when neither is reached, and a
    series that ends decides by its last close."""
    w = Layout.window()
    rows = 5 * days - 1
    df = layout.spread(df, after=rows).withColumn(
        "_next", F.collect_list(F.struct("date", "close")).over(w.rowsBetween(1, rows))
    )
    entry, limit = F.col("close"), F.date_add("date", days)
    final = F.coalesce(
        F.get(F.filter("_next", lambda x: x["date"] > limit), F.lit(0)), F.try_element_at("_next", F.lit(-1))
    )
    label = (
        F.when(F.exists("_next", lambda x: x["close"] >= entry * (1 + profit)), 1)
        .when(F.exists("_next", lambda x: x["close"] <= entry * (1 - stop)), -1)
        .otherwise(_sign(final["close"] - entry))
    )
    return Layout.core(df.withColumn("label", label).drop("_next"))


def label_distribution(df: DataFrame, label: str, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Rows and share of every label value per key; the shares run over the counts."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy(*keys)))


def named_labels(df: DataFrame, target: str = "target") -> DataFrame:
    name = F.when(F.col(target) == 1, "BUY").when(F.col(target) == 0, "SELL").otherwise("HOLD")
    return df.withColumn("label", name)
