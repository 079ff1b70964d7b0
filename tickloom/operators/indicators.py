"""Technical features over one ticker: rolling windows and recurrences.

Both kinds share one layout of the rows, so the whole feature table takes one
exchange on (ticker, chunk) and one sort; the selects below only add window
stages on top of that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.series import (
    ROW, Layout, decayed_states, div, ema_decay, ema_step, from_row, long_extreme, long_mean, long_stddev, looked_up, pct_change, roll,
    running_sum, trailing,
)

ROLLING_BEFORE = 300   # 252-row z-score of a 20-row deviation, and one lag
SEED_BEFORE = 52       # the plain mean that seeds a 50-row exponential mean, and one lag
EPS = 1e-8

# Smoothing of the conditional variance.
GARCH_ALPHA, GARCH_BETA, GARCH_WARMUP = 0.1, 0.85, 20


def _base(df: DataFrame, w: WindowSpec) -> DataFrame:
    """One-row-back inputs shared by the rolling and the recursive features."""
    prev = F.lag("close").over(w)
    df = df.select(
        "*",
        prev.alias("_prev"),
        (F.col("close") - prev).alias("_diff"),
        (F.col("high") - F.lag("high").over(w)).alias("_up"),
        (F.lag("low").over(w) - F.col("low")).alias("_down"),
        ((F.col("high") + F.col("low") + F.col("close")) / 3).alias("hlc3"),
    )
    return df.withColumns({
        "log_returns": F.ln(div(F.col("close"), F.col("_prev"))),
        "true_range": F.when(
            F.col("_prev").isNotNull(),
            F.greatest(
                F.col("high") - F.col("low"),
                F.abs(F.col("high") - F.col("_prev")),
                F.abs(F.col("_prev") - F.col("low")),
            ),
        ),
        "_flow": F.col("hlc3") * F.col("volume"),
    })


def _drop_base(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def _rolling(df: DataFrame, w: WindowSpec) -> DataFrame:
    close, high, low, volume = (F.col(c) for c in ("close", "high", "low", "volume"))
    hlc_step = F.col("hlc3") - F.lag("hlc3").over(w)
    df = df.withColumns({
        "volatility_20": roll(F.stddev_samp, close, 20, w),
        "volatility_5": roll(F.stddev_samp, close, 5, w),
        "volume_ma_20": roll(F.avg, volume, 20, w),
        "_sma20": roll(F.avg, close, 20, w),
        "_sma10": roll(F.avg, close, 10, w),
        "_high21": roll(F.max, high, 21, w),
        "_low21": roll(F.min, low, 21, w),
        "_std20": roll(F.stddev_pop, close, 20, w),
        "_low14": roll(F.min, low, 14, w),
        "_high14": roll(F.max, high, 14, w),
        "roc_10": 100 * pct_change(close, w, 10),
        "roc_20": 100 * pct_change(close, w, 20),
        "volume_roc_10": 100 * pct_change(volume, w, 10),
        "price_momentum_10d": pct_change(close, w, 10),
        "vix_change": pct_change(F.col("vix_filled"), w),
        "_flow_in": F.when(hlc_step > 0, F.col("_flow")).otherwise(0.0),
        "_flow_out": F.when(hlc_step < 0, F.col("_flow")).otherwise(0.0),
        "high_low_ratio": div(high - low, close),
        "close_open_ratio": div(close - F.col("open"), F.col("open")),
        "close_vix_ratio": div(close, F.col("vix_close")),
    })
    vol = F.col("volatility_20")
    df = df.withColumns({
        "_sma10s": looked_up("_sma10", 10, 5, w),
        "_sma20s": looked_up("_sma20", 20, 10, w),
        "_high21s": looked_up("_high21", 21, 12, w),
        "_low21s": looked_up("_low21", 21, 12, w),
        "_vol21": roll(F.avg, vol, 21, w),
        "_volvar21": roll(F.var_pop, vol, 21, w),
    })
    df = df.withColumns({
        "_sma50": long_mean("_sma10s", 5),
        "sma_100": long_mean("_sma20s", 5),
        "ma_200": long_mean("_sma20s", 10),
        "high_52w": long_extreme(F.greatest, "_high21s", 12),
        "low_52w": long_extreme(F.least, "_low21s", 12),
        "_vol21s": looked_up("_vol21", 21, 12, w),
        "_volvar21s": looked_up("_volvar21", 21, 12, w),
    })
    df = df.withColumn("_vol252", long_mean("_vol21s", 12)).withColumns({
        "volume_ratio": div(volume, F.col("volume_ma_20")),
        "volume_ma_ratio": volume / (F.col("volume_ma_20") + EPS),
        "price_to_sma20": div(close, F.col("_sma20")),
        "price_to_sma50": div(close, F.col("_sma50")),
        "price_to_52w_high": div(close, F.col("high_52w")),
        "price_to_52w_low": div(close, F.col("low_52w")),
        "distance_to_ma200": div(close - F.col("ma_200"), close),
        "rolling_volatility_zscore": (
            (vol - F.col("_vol252")) / (long_stddev("_vol21s", "_volvar21s", F.col("_vol252"), 21, 12) + EPS)
        ),
        "bb_mid": F.col("_sma20"),
        "bb_lower": F.col("_sma20") - 2 * F.col("_std20"),
        "bb_upper": F.col("_sma20") + 2 * F.col("_std20"),
        "_stoch": F.when(F.col("_high14") == F.col("_low14"), 0.0).otherwise(
            100 * div(close - F.col("_low14"), F.col("_high14") - F.col("_low14"))
        ),
        "_in14": roll(F.sum, F.col("_flow_in"), 14, w),
        "_out14": roll(F.sum, F.col("_flow_out"), 14, w),
    })
    z, dist = F.col("rolling_volatility_zscore"), F.col("distance_to_ma200")
    vol_state = F.when(z > 1, 1).when(z < -1, -1).otherwise(0)
    trend_state = F.when(dist >= 0, 1).otherwise(-1)
    df = df.withColumns({
        "bb_width": 100 * div(F.col("bb_upper") - F.col("bb_lower"), F.col("bb_mid")),
        "bb_percent": div(close - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")),
        "stoch_k": roll(F.avg, F.col("_stoch"), 3, w),
        "mfi": 100 * div(F.col("_in14"), F.col("_in14") + F.col("_out14")),
        "regime_state": (vol_state * 2 + trend_state).cast("int"),
    })
    return df.withColumns({
        "stoch_d": roll(F.avg, F.col("stoch_k"), 3, w),
        "regime_change": F.coalesce(F.col("regime_state") != F.lag("regime_state").over(w), F.lit(True)).cast("int"),
    })


def _states(df: DataFrame, w: WindowSpec, layout: Layout) -> DataFrame:
    """Recurrences in two rounds: those of the prices, then those of what the first round gives."""
    close, diff, tr = F.col("close"), F.col("_diff"), F.col("true_range")
    up, down = F.col("_up"), F.col("_down")
    known = diff.isNotNull()
    early = F.when(F.col(ROW).between(2, GARCH_WARMUP + 1), F.col("log_returns"))
    whole = w.rowsBetween(-GARCH_WARMUP, GARCH_WARMUP)
    df = df.withColumns({
        "_gain": F.when(known, F.greatest(diff, F.lit(0.0))),
        "_loss": F.when(known, F.greatest(-diff, F.lit(0.0))),
        "_dm_up": F.when(known, F.when((up > down) & (up > 0), up).otherwise(0.0)),
        "_dm_down": F.when(known, F.when((down > up) & (down > 0), down).otherwise(0.0)),
        "_known": F.when(known, F.lit(1.0)),
        "_ranged": F.when(tr.isNotNull(), F.lit(1.0)),
        "_e12": ema_step(close, 12, w),
        "_e26": ema_step(close, 26, w),
        "_e20": ema_step(close, 20, w),
        "_e50": ema_step(close, 50, w),
        "_etr": ema_step(tr, 20, w),
        "_shock": F.when(F.col(ROW) > GARCH_WARMUP + 1, GARCH_ALPHA * F.pow(F.lag("log_returns").over(w), 2)),
        "_early": F.when(F.count(early).over(whole) == GARCH_WARMUP, F.stddev_pop(early).over(whole)),
    })
    d14, d21 = 1 - 1 / 14, 1 - 1 / 21
    df = decayed_states(df, {
        "_s_gain14": ("_gain", d14), "_s_loss14": ("_loss", d14), "_s_gain21": ("_gain", d21), "_s_loss21": ("_loss", d21),
        "_s_range": ("true_range", d14), "_s_up": ("_dm_up", d14), "_s_down": ("_dm_down", d14),
        "_n_known14": ("_known", d14), "_n_known21": ("_known", d21), "_n_range": ("_ranged", d14),
        "_s_e12": ("_e12", ema_decay(12)), "_s_e26": ("_e26", ema_decay(26)), "_s_e20": ("_e20", ema_decay(20)),
        "_s_e50": ("_e50", ema_decay(50)), "_s_etr": ("_etr", ema_decay(20)), "_s_shock": ("_shock", GARCH_BETA),
    }, layout)

    def smooth(total: str, weight: str, n: int, first_row: int = 2) -> Column:
        """Exponential mean with alpha 1/n and normalised weights, once ``n`` values are there."""
        return from_row(first_row + n - 1, div(F.col(total), F.col(weight)))

    df = df.withColumns({
        "_g14": smooth("_s_gain14", "_n_known14", 14), "_l14": smooth("_s_loss14", "_n_known14", 14),
        "_g21": smooth("_s_gain21", "_n_known21", 21), "_l21": smooth("_s_loss21", "_n_known21", 21),
        "atr": smooth("_s_range", "_n_range", 14),
        "_du": smooth("_s_up", "_n_known14", 14), "_dd": smooth("_s_down", "_n_known14", 14),
        "ema_short": from_row(20, F.col("_s_e20")), "ema_long": from_row(50, F.col("_s_e50")),
        "_fast": from_row(12, F.col("_s_e12")), "_slow": from_row(26, F.col("_s_e26")),
        "_band": from_row(20, F.col("_s_etr")),
        "garch_volatility": F.when(F.col(ROW) > GARCH_WARMUP + 1, F.sqrt(F.abs(F.col("_s_shock")))).when(F.col(ROW) >= 2, F.col("_early")),
    })
    df = df.withColumns({
        "rsi_14": 100 * div(F.col("_g14"), F.col("_g14") + F.col("_l14")),
        "rsi_21": 100 * div(F.col("_g21"), F.col("_g21") + F.col("_l21")),
        "macd": F.col("_fast") - F.col("_slow"),
        "DMP_14": 100 * div(F.col("_du"), F.col("atr")),
        "DMN_14": 100 * div(F.col("_dd"), F.col("atr")),
        "kc_mid": F.col("ema_short"),
        "kc_lower": F.col("ema_short") - 2 * F.col("_band"),
        "kc_upper": F.col("ema_short") + 2 * F.col("_band"),
    })
    plus, minus = F.col("DMP_14"), F.col("DMN_14")
    df = df.withColumns({
        "rsi": F.col("rsi_14"),
        "_dx": 100 * div(F.abs(plus - minus), plus + minus),
        "_esig": ema_step(F.col("macd"), 9, w, first_row=26),
    })
    df = decayed_states(df.withColumn("_moved", F.when(F.col("_dx").isNotNull(), F.lit(1.0))), {
        "_s_dx": ("_dx", d14), "_n_dx": ("_moved", d14), "_s_esig": ("_esig", ema_decay(9)),
    }, layout)
    df = df.withColumns({
        "ADX_14": smooth("_s_dx", "_n_dx", 14, first_row=15),
        "macds": from_row(34, F.col("_s_esig")),
    })
    return df.withColumn("macdh", F.col("macd") - F.col("macds"))


def rolling_features(bars: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Bars plus every feature with a bounded look-back."""
    w = Layout.window()
    return Layout.core(_drop_base(_rolling(_base(layout.spread(bars, before=ROLLING_BEFORE), w), w)))


def rolling_volatility(bars: DataFrame, layout: Layout = Layout(), n: int = 20) -> DataFrame:
    """Bars plus the rolling deviation of the close only."""
    w = Layout.window()
    return Layout.core(layout.spread(bars, before=n).withColumn(f"volatility_{n}", roll(F.stddev_samp, F.col("close"), n, w)))


def recursive_features(bars: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Bars plus the exponential means and the indicators built on them."""
    w = Layout.window()
    df = _base(layout.spread(bars, before=SEED_BEFORE), w)
    return Layout.core(_drop_base(_states(df, w, layout)).drop("hlc3", "log_returns"))


def on_balance_volume(bars: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Running volume signed by the direction of the close; the first row counts as up."""
    w = Layout.window()
    step = F.col("close") - F.lag("close").over(w)
    spread = layout.spread(bars, before=1).withColumn(
        "_signed", F.coalesce(F.signum(step), F.lit(1.0)) * F.col("volume")
    )
    return running_sum(Layout.core(spread), "_signed", layout, "obv").drop("_signed")


def engineer_features(bars: DataFrame, layout: Layout = Layout(), adx: bool = True) -> DataFrame:
    """The technical feature table: one layout on (ticker, chunk) for all of it, beside the end states of chunks.

    ``adx=False`` puts the neutral value 20 in ``ADX_14``.
    """
    w = Layout.window()
    df = _base(layout.spread(bars, before=ROLLING_BEFORE), w)
    df = _drop_base(_states(_rolling(df, w), w, layout))
    if not adx:
        df = df.withColumn("ADX_14", F.lit(20.0))
    return interactions(Layout.core(df))


def interactions(df: DataFrame) -> DataFrame:
    """Ratios and products of other features; products only where a latent is present."""
    ratio = div(F.col("atr"), F.col("close"))
    df = df.withColumns({
        "atr_price_ratio": ratio,
        "risk_adjusted_momentum": F.col("price_momentum_10d") / (ratio + EPS),
    })
    for i in (0, 3, 4):
        if f"lstm_latent_{i}" in df.columns:
            latent = F.col(f"lstm_latent_{i}")
            df = df.withColumns({
                f"lstm{i}_×_rsi": latent * F.col("rsi_14") / 100,
                f"lstm{i}_×_macd": latent * F.col("macd"),
                f"lstm{i}_×_trend": latent * F.col("distance_to_ma200"),
            })
    return df


# --- the second feature family ---------------------------------------------------------

def fractional_weights(d: float, size: int = 10) -> list[float]:
    weights = [1.0]
    for i in range(1, size):
        weights.append(-weights[-1] * (d - i + 1) / i)
    return weights


def fractional_difference(value: Column, d: float, w: WindowSpec, size: int = 10) -> Column:
    """Weighted sum of the last ``size`` values, first weight on the oldest; needs ``size + 1`` rows."""
    terms = [weight * F.lag(value, size - 1 - k).over(w) for k, weight in enumerate(fractional_weights(d, size))]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return F.when(F.col(ROW) > size, total)


def percent_rank_last(value: Column, n: int, w: WindowSpec) -> Column:
    """Rank of the last value among the last ``n``, ties averaged, as a share of ``n``."""
    seen = F.collect_list(value).over(trailing(w, n))
    below = F.size(F.filter(seen, lambda x: x < value))
    equal = F.size(F.filter(seen, lambda x: x == value))
    return F.when((F.size(seen) == n) & value.isNotNull(), (below + (equal + 1) / 2) / n)


def market_structure_features(bars: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Fractional differences, volume-weighted price deviations, volatility regime."""
    w = Layout.window()
    close, volume = F.col("close"), F.col("volume")
    df = layout.spread(bars, before=ROLLING_BEFORE).withColumns({
        "_log": F.ln("close"),
        "_traded": close * volume,
        "volatility_20": roll(F.stddev_samp, close, 20, w),
    })
    vwap = {n: div(roll(F.sum, F.col("_traded"), n, w), roll(F.sum, volume, n, w)) for n in (5, 10, 20)}
    df = df.withColumns({
        **{f"fd_price_{round(d * 10)}": fractional_difference(F.col("_log"), d, w) for d in (0.3, 0.5, 0.7)},
        "vwap": vwap[20],
        **{f"vwap_{n}d_deviation": div(close - v, v) for n, v in vwap.items()},
        "vol_vs_mean": div(F.col("volatility_20"), roll(F.avg, F.col("volatility_20"), 20, w)),
        # Deviations of the same closes in another order differ in the last bits only: a tie.
        "vol_regime": percent_rank_last(F.round("volatility_20", 10), 60, w),
    })
    return Layout.core(_drop_base(df.withColumn("vwap_deviation", div(close - F.col("vwap"), F.col("vwap")))))


def debug_emas(bars: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Exponential means of span 12 and 26 with weights normalised over the rows seen so far."""
    df = layout.spread(bars).withColumn("_one", F.when(F.col("close").isNotNull(), F.lit(1.0)))
    df = decayed_states(df, {
        **{f"_s{n}": ("close", ema_decay(n)) for n in (12, 26)}, **{f"_n{n}": ("_one", ema_decay(n)) for n in (12, 26)},
    }, layout)
    return Layout.core(_drop_base(df.withColumns({f"ema_{n}": div(F.col(f"_s{n}"), F.col(f"_n{n}")) for n in (12, 26)})))
