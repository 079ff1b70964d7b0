"""Settings of a forecast run, as one immutable object passed to the operators."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Defaults of a forecast run.
LABEL_UP, LABEL_DOWN, LABEL_HORIZON = 2.0, 1.5, 20
RISK_TYPE, RISK_VOL_METRIC = "Volatility_Adjusted", "rolling_std_20d"
LOOKBACK_DAYS = 6 * 365
BENCHMARK_SEEDS = (42, 77, 101, 123, 777)

# Features requested from the feature table, in contract order.
SEED_FEATURES = (
    *(f"lstm_latent_{i}" for i in range(10)),
    "rolling_volatility_zscore", "distance_to_ma200", "regime_state", "regime_change",
    "rsi", "macd", "macds", "roc_20",
    "atr", "volatility_20",
    "ema_short", "ema_long", "price_to_sma20", "ADX_14",
    "volume_ratio", "mfi",
    "close_vix_ratio", "vix_change",
    "lstm_dir_5d", "lstm_dir_10d", "lstm_dir_20d", "lstm_return_confidence",
)

# Columns that no feature filter may drop.
PROTECTED = ("date", "open", "high", "low", "close", "volume", "target", "vix_close", "forward_return")

# Features that the correlation filter keeps on top of PROTECTED.
KEPT_IN_CORRELATION_FILTER = (
    "lstm_latent_0", "lstm_latent_3", "lstm_latent_4", "lstm_latent_5",
    "ema_short", "ema_long", "distance_to_ma200", "close_vix_ratio",
    "volatility_20", "atr", "ADX_14", "macds", "macd",
    "lstm_latent_1", "lstm_latent_6", "lstm_latent_7", "lstm_latent_9",
    "price_to_sma20", "volume_ratio", "mfi",
)

# Features dropped as known low importance.
LOW_IMPORTANCE = (
    "lstm_latent_2", "rsi", "rolling_volatility_zscore", "regime_state",
    "regime_change", "vix_change", "volume_roc_10", "volume_ratio",
)

# Probability a final recommendation must reach, by risk profile.
PROFILE_THRESHOLD = {"conservative": 0.68, "balanced": 0.62, "aggressive": 0.55}


@dataclass(frozen=True)
class Settings:
    # walk-forward folds, counted in labelled rows
    n_splits: int | None = None  # as many as the rows give, unless limited here
    train_rows: int = 400
    val_rows: int = 120
    min_train: int = 252
    min_val: int = 60
    purge_rows: int = 20
    embargo_rows: int = 20
    min_trades: int = 3
    # costs
    cost_bps: float = 20.0
    slippage_bps: float = 5.0
    # threshold search
    search_mode: str = "quantile"
    search_min_trades: int = 10
    min_trades_ratio: float = 0.08
    trade_ratio_floor: float = 0.09
    target_coverage: float = 0.16
    turnover_penalty: float = 0.15
    default_buy: float = 0.65
    default_sell: float = 0.35
    # adaptive threshold
    max_shift: float = 0.04
    smoothing: float = 0.35
    z_clip: float = 2.5
    # signals
    trading_mode: str = "long_only"
    risk_profile: str = "conservative"
    th_min: float = 0.60
    th_max: float = 0.64
    percentile: float = 70.0
    balanced_percentile: float = 60.0
    max_trade_ratio: float = 0.22
    gate_vol_z: float = 1.80
    gate_bear_ratio: float = 0.60
    # position size
    size_min_confidence: float = 0.55
    size_band: float = 0.08
    size_vol_penalty: float = 0.35
    size_max: float = 1.0
    conservative_confidence: float = 0.62
    conservative_band: float = 0.12
    conservative_penalty_mult: float = 1.25
    # risk
    k_tp: float = 2.5
    k_sl: float = 1.25

    @property
    def conservative(self) -> bool:
        return self.risk_profile == "conservative"

    @property
    def trade_cost(self) -> float:
        return (self.cost_bps + self.slippage_bps) / 10000.0

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)
