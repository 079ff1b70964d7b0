"""Named queries over the sales tables, each with the same question in SQL where SQL can ask it."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType

from tickloom.functions.series import Layout, tail
from tickloom.operators import (
    backtest, boosting, calibration, contract, evaluation, folds, indicators, labels, models, profile, recommendation,
    runlog, selection, sequences, signals,
)
from tickloom.plans import market as mk
from tickloom.plans import oracle as o
from tickloom.plans.benchmark import CANDIDATES, ENCODERS, Benchmark, candidates
from tickloom.plans.forecast import fold_rows, forecast, keeper
from tickloom.plans.oracle import r, rs, sql
from tickloom.settings import BENCHMARK_SEEDS, LOW_IMPORTANCE, SEED_FEATURES, Settings
from tickloom.sources import bars as bar_source
from tickloom.sources import candidates as candidate_source
from tickloom.sources import json_log
from tickloom.sources import stages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


DATES = ("date", "last_date", "first_date")


def query(name: str, oracle: str | None = None, dates: tuple[str, ...] | None = None):
    """Register a query.  Days are given as text on both sides, as engines hand them over in
    different types; ``dates`` names them where the SQL does not show it."""
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.withColumns({f.name: F.col(f.name).cast("string") for f in df.schema if isinstance(f.dataType, DateType)})

        QUERIES[name] = run
        if oracle:
            shown = re.sub(r"\([^()]*\)", "", oracle.rsplit("\nSELECT", 1)[-1].split(" FROM ")[0])
            days = [d for d in DATES if re.search(rf"(^|[,\s.]){d}\s*(,|$)", shown)] if dates is None else dates
            casts = ", ".join(f"CAST({d} AS VARCHAR) AS {d}" for d in days)
            ORACLE[name] = f"SELECT * REPLACE ({casts}) FROM (\n{oracle})" if casts else oracle
        return fn
    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to fixed digits (and no negative zero), so that engines can be compared.

    Prices have two decimals, so exact midpoints do occur; ``o.nudge`` moves them off it.
    """
    return df.select(*[
        (F.round(F.col(f.name).cast("double") + o.nudge(digits), digits) + 0.0).alias(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f"`{f.name}`") for f in df.schema
    ])


def pick(df: DataFrame, names: str, digits: int = 6) -> DataFrame:
    return rounded(df.select(*names.split()), digits)


stage_root: str | None = None  # folder for stage tables; None takes the one the cluster names


@lru_cache(maxsize=None)
def _market(spark: SparkSession, sf_dir: str, by_brand: bool, root: str | None) -> mk.Market:
    return mk.Market(spark, sf_dir, by_brand, root=root)


def market(spark: SparkSession, sf_dir: str, by_brand: bool = False) -> mk.Market:
    return _market(spark, sf_dir, by_brand, stage_root)


BARS, ROLL, STATES = o.bars_cte(), o.ROLLING, o.STATES
BARRIERS = o.barrier_cte()
TO_LABELS = (BARS, ROLL, STATES, BARRIERS)
TO_FOLDS = (*TO_LABELS, o.LABELLED, o.FOLDS)
TO_PREDS = (*TO_FOLDS, o.SCORES)
TO_SIGNALS = (*TO_PREDS, o.signals_cte())
TO_RESULTS = (*TO_SIGNALS, o.results_cte())
TO_RUNS = (*TO_RESULTS, o.cross_cte())

# --- sources -----------------------------------------------------------------------------------

BAR = "ticker date open high low close volume vix_close"


@query("bars_with_index", sql(BARS, select=f"SELECT ticker, date, {rs('open high low close volume vix_close', 10)} FROM bars"))
def _(spark, sf):
    return pick(mk.bars(spark, sf), BAR, 10)


@query("bars_by_brand", sql(o.bars_cte(True), select=f"SELECT ticker, date, {rs('open high low close volume vix_close', 10)} FROM bars"))
def _(spark, sf):
    return pick(mk.bars(spark, sf, by_brand=True), BAR, 10)


@query("bars_lookback", sql(BARS, select=f"SELECT ticker, date, {rs('close volume')} FROM bars "
                            "WHERE date >= DATE '2001-06-30' - 2190 AND date <= DATE '2001-06-30'"))
def _(spark, sf):
    return pick(bar_source.lookback(mk.trade_bars(spark, sf), "2001-06-30"), "ticker date close volume")


@query("bars_date_range", sql(BARS, select=f"SELECT ticker, date, {rs('open close')} FROM bars "
                              "WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"))
def _(spark, sf):
    return pick(bar_source.between_dates(mk.trade_bars(spark, sf), "1996-01-01", "1996-12-31"), "ticker date open close")


@query("numbered_bars_filled_index", sql(BARS, select=f"SELECT ticker, date, rn, {rs('vix_close vix_filled', 10)} FROM bars"))
def _(spark, sf):
    return pick(market(spark, sf).bars(), "ticker date rn vix_close vix_filled", 10)


@query("bars_fingerprint")
def _(spark, sf):
    return stages.fingerprint(market(spark, sf).bars(), ["open", "high", "low", "close", "volume", "vix_close"])


@query("fold_cache_keys", sql(*TO_FOLDS, select="""SELECT ticker, fold, sha1(concat_ws('|', 'off', '{"window": 60}', ticker,
  CAST(min(date) FILTER (role = 'train') AS VARCHAR), CAST(max(date) FILTER (role = 'train') AS VARCHAR),
  CAST(min(date) FILTER (role = 'val') AS VARCHAR), CAST(max(date) FILTER (role = 'val') AS VARCHAR),
  CAST(count(*) FILTER (role = 'train') AS VARCHAR), CAST(count(*) FILTER (role = 'val') AS VARCHAR))) AS fold_key FROM members GROUP BY ticker, fold"""))
def _(spark, sf):
    return stages.fold_keys(market(spark, sf).members(), "off", {"window": 60}).select("ticker", "fold", "fold_key")


# --- projections and null handling ---------------------------------------------------------------

@query("numeric_coercion", """SELECT o_orderpriority, try_cast(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS level,
  try_cast(split_part(o_orderpriority, '-', 2) AS DOUBLE) AS word, count(*) AS n_rows FROM orders GROUP BY 1, 2, 3""")
def _(spark, sf):
    part = F.split("o_orderpriority", "-")
    return mk.load(spark, sf, "orders").groupBy(
        "o_orderpriority", part[0].try_cast("double").alias("level"), part[1].try_cast("double").alias("word")
    ).agg(F.count(F.lit(1)).alias("n_rows"))


@query("complete_rows", sql(*TO_LABELS, o.LABELLED, select=f"SELECT ticker, date, bar_rn, rn, target, {rs('close volatility_20 price_to_sma20 distance_to_ma200', 8)} FROM labelled"))
def _(spark, sf):
    return pick(market(spark, sf).labelled(), "ticker date bar_rn rn target close volatility_20 price_to_sma20 distance_to_ma200", 8)


@query("last_rows", sql(BARS, select=f"SELECT ticker, date, {r('close')} FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 30"))
def _(spark, sf):
    return pick(tail(market(spark, sf).bars(), 30), "ticker date close")


PLACEHOLDERS = "lstm_price_5d lstm_return_10d lstm_dir_20d lstm_return_confidence lstm_latent_9"


@query("placeholder_columns", sql(BARS, select=f"SELECT ticker, date, {r('close', 'lstm_price_5d')}, 0.0::DOUBLE AS lstm_return_10d, "
                                  "0.5::DOUBLE AS lstm_dir_20d, 0.0::DOUBLE AS lstm_return_confidence, 0.0::DOUBLE AS lstm_latent_9 FROM bars"))
def _(spark, sf):
    return pick(sequences.placeholder_columns(market(spark, sf).bars()), f"ticker date {PLACEHOLDERS}")


@query("adapted_columns", sql(BARS, select=f"SELECT ticker, date, {r('close * 1.01', 'lstm_price_5d')}, {r('close', 'lstm_price_10d')}, "
                              "0.01::DOUBLE AS lstm_return_5d, 0.5::DOUBLE AS lstm_dir_5d FROM bars"))
def _(spark, sf):
    tcn = market(spark, sf).bars().withColumns({"tcn_price_5d": F.col("close") * 1.01, "tcn_return_5d": F.lit(0.01)})
    return pick(sequences.adapt_columns(tcn), "ticker date lstm_price_5d lstm_price_10d lstm_return_5d lstm_dir_5d")


@query("overwritten_fold_columns", sql(*TO_PREDS, select=f"""SELECT ticker, fold, date, round(CASE WHEN fold % 2 = 0 THEN 2 * s1 ELSE s1 END + 3.7e-08, 6) + 0.0 AS price_to_sma20_scaled FROM preds"""))
def _(spark, sf):
    preds = market(spark, sf).predictions()
    fresh = preds.filter("fold % 2 = 0").select("ticker", "fold", "date", (2 * F.col("price_to_sma20_scaled")).alias("price_to_sma20_scaled"))
    return pick(sequences.overwrite_columns(preds, fresh, ["price_to_sma20_scaled"]), "ticker fold date price_to_sma20_scaled")


# --- rolling features ------------------------------------------------------------------------------

ROLLING_GROUPS = {
    "rolling_price": "log_returns high_low_ratio close_open_ratio price_to_sma20 price_to_sma50 sma_100 ma_200 high_52w low_52w "
                     "price_to_52w_high price_to_52w_low price_momentum_10d hlc3 true_range",
    "rolling_volatility": "volatility_20 volatility_5 rolling_volatility_zscore distance_to_ma200 bb_lower bb_mid bb_upper bb_width bb_percent",
    "rolling_momentum": "roc_10 roc_20 stoch_k stoch_d mfi",
    "rolling_volume_index": "volume_ma_20 volume_ratio volume_ma_ratio volume_roc_10 close_vix_ratio vix_change",
}


def _rolling_query(name: str, cols: str) -> None:
    @query(name, sql(BARS, ROLL, select=f"SELECT ticker, date, {rs(cols, 8)} FROM rolling"))
    def _(spark, sf):
        return pick(indicators.rolling_features(market(spark, sf).bars()), f"ticker date {cols}", 8)


for _name, _cols in ROLLING_GROUPS.items():
    _rolling_query(_name, _cols)


@query("rolling_in_small_chunks", sql(BARS, ROLL, select=f"SELECT ticker, date, {rs('ma_200 high_52w rolling_volatility_zscore stoch_d')} FROM rolling"))
def _(spark, sf):
    return pick(indicators.rolling_features(market(spark, sf).bars(), Layout(400)), "ticker date ma_200 high_52w rolling_volatility_zscore stoch_d")


@query("regime_states", sql(BARS, ROLL, select="SELECT ticker, date, regime_state, regime_change FROM rolling"))
def _(spark, sf):
    return indicators.rolling_features(market(spark, sf).bars()).select("ticker", "date", "regime_state", "regime_change")


def _fractional_sql(d: float) -> str:
    # Binomial weights (-1)^k C(d, k) by the gamma function.
    weights = [math.gamma(k - d) / (math.gamma(-d) * math.gamma(k + 1)) for k in range(10)]
    terms = " + ".join(f"({w!r}) * lag(ln(close), {9 - k}) OVER w" for k, w in enumerate(weights))
    return f"round(CASE WHEN rn > 10 THEN {terms} END + 3.7e-08, 6) + 0.0 AS fd_price_{round(d * 10)}"


@query("fractional_differences", sql(BARS, select=f"SELECT ticker, date, {', '.join(_fractional_sql(d) for d in (0.3, 0.5, 0.7))} FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY rn)"))
def _(spark, sf):
    return pick(indicators.market_structure_features(market(spark, sf).bars()), "ticker date fd_price_3 fd_price_5 fd_price_7")


def _vwap(n: int) -> str:
    return f"({o.roll('sum', 'traded', n)}) / ({o.roll('sum', 'volume', n)})"


@query("vwap_deviations", sql(BARS, "t AS (SELECT *, close * volume AS traded FROM bars)", select="SELECT ticker, date, "
       f"{r(_vwap(20), 'vwap')}, {r(f'(close - {_vwap(20)}) / ({_vwap(20)})', 'vwap_deviation')}, "
       + ", ".join(r(f"(close - {_vwap(n)}) / ({_vwap(n)})", f"vwap_{n}d_deviation") for n in (5, 10, 20)) + " FROM t"))
def _(spark, sf):
    return pick(indicators.market_structure_features(market(spark, sf).bars()),
                "ticker date vwap vwap_deviation vwap_5d_deviation vwap_10d_deviation vwap_20d_deviation")


@query("volatility_ranks", sql(BARS, ROLL, f"""m AS (SELECT ticker, date, rn, volatility_20, volatility_20 / nullif({o.roll('avg', 'volatility_20', 20)}, 0) AS vol_vs_mean FROM rolling),
k AS (SELECT a.ticker, a.rn, (count(*) FILTER (round(b.volatility_20, 10) < round(a.volatility_20, 10)) + (count(*) FILTER (round(b.volatility_20, 10) = round(a.volatility_20, 10)) + 1) / 2) / 60 AS vol_regime
  FROM m a JOIN m b ON a.ticker = b.ticker AND b.rn BETWEEN a.rn - 59 AND a.rn WHERE b.volatility_20 IS NOT NULL AND a.volatility_20 IS NOT NULL GROUP BY a.ticker, a.rn HAVING count(*) = 60)""",
       select=f"SELECT ticker, date, {rs('vol_vs_mean vol_regime')} FROM m LEFT JOIN k USING (ticker, rn)"))
def _(spark, sf):
    return pick(indicators.market_structure_features(market(spark, sf).bars()), "ticker date vol_vs_mean vol_regime")


@query("feature_interactions", sql(BARS, ROLL, STATES, select=f"""SELECT ticker, r.date, {r('atr / r.close', 'atr_price_ratio')},
  {r('price_momentum_10d / (atr / r.close + 1e-8)', 'risk_adjusted_momentum')}, {r('r.close * rsi_14 / 100', 'lstm0_rsi')},
  {r('r.close * macd', 'lstm0_macd')}, {r('r.close * distance_to_ma200', 'lstm0_trend')} FROM rolling r JOIN states USING (ticker, rn)"""))
def _(spark, sf):
    df = indicators.interactions(market(spark, sf).features().withColumn("lstm_latent_0", F.col("close")))
    for c in ("rsi", "macd", "trend"):
        df = df.withColumnRenamed(f"lstm0_×_{c}", f"lstm0_{c}")
    return pick(df, "ticker date atr_price_ratio risk_adjusted_momentum lstm0_rsi lstm0_macd lstm0_trend")


# --- recurrences -------------------------------------------------------------------------------------

STATE_GROUPS = {
    "exponential_means": "ema_short ema_long macd macds macdh kc_lower kc_upper",
    "directional_strength": "rsi_14 rsi_21 atr DMP_14 DMN_14 ADX_14",
    "garch_volatility": "garch_volatility",
}


def _state_query(name: str, cols: str, layout: Layout = Layout()) -> None:
    quoted = ", ".join(r(f'"{c}"', f'"{c}"') for c in cols.split())

    @query(name, sql(BARS, STATES, select=f"SELECT ticker, date, {quoted} FROM states"))
    def _(spark, sf):
        return pick(indicators.recursive_features(market(spark, sf).bars(), layout), f"ticker date {cols}")


for _name, _cols in STATE_GROUPS.items():
    _state_query(_name, _cols)
_state_query("recurrences_in_small_chunks", "ema_long macds rsi_21 atr ADX_14 garch_volatility", Layout(1200))

# Prices that stand still after row 300: ratios of states live on what happened before.
STILL = f"""{o.bars_cte(name="moving")},
bars AS MATERIALIZED (SELECT m.* REPLACE (CASE WHEN rn > 300 THEN held ELSE close END AS close, CASE WHEN rn > 300 THEN held ELSE high END AS high,
  CASE WHEN rn > 300 THEN held ELSE low END AS low) FROM moving m LEFT JOIN (SELECT ticker, close AS held FROM moving WHERE rn = 300) USING (ticker))"""
STILL_COLS = "ema_long macds rsi_14 rsi_21 DMP_14 DMN_14 ADX_14"


def still_bars(bars: DataFrame) -> DataFrame:
    held = bars.filter("rn = 300").select("ticker", F.col("close").alias("held"))
    kept = {c: F.when(F.col("rn") > 300, F.col("held")).otherwise(F.col(c)) for c in ("close", "high", "low")}
    return bars.join(held, "ticker", "left").withColumns(kept).drop("held")


@query("recurrences_after_standstill", sql(STILL, STATES, select="SELECT ticker, date, " + ", ".join(r(f'"{c}"', f'"{c}"') for c in STILL_COLS.split()) + " FROM states"))
def _(spark, sf):
    return pick(indicators.recursive_features(still_bars(market(spark, sf).bars()), Layout(256)), f"ticker date {STILL_COLS}")


@query("on_balance_volume", sql(BARS, f"t AS (SELECT *, coalesce(sign(close - {o.lag('close')}), 1) * volume AS sv FROM bars)", select=(
    f"SELECT ticker, date, {r('sum(sv) OVER (PARTITION BY ticker ORDER BY rn)', 'obv')} FROM t")))
def _(spark, sf):
    return pick(indicators.on_balance_volume(market(spark, sf).bars(), Layout(500)), "ticker date obv")


def _adjusted(n: int) -> str:
    a = 1 - 2 / (n + 1)
    return f"e{n} * {a!r} + close, w{n} * {a!r} + 1"


@query("normalised_means", sql(BARS, f"""e AS (SELECT ticker, rn, date, close AS e12, 1.0::DOUBLE AS w12, close AS e26, 1.0::DOUBLE AS w26 FROM bars WHERE rn = 1
  UNION ALL SELECT b.ticker, b.rn, b.date, {_adjusted(12).replace('close', 'b.close')}, {_adjusted(26).replace('close', 'b.close')} FROM e JOIN bars b ON b.ticker = e.ticker AND b.rn = e.rn + 1)""",
       select=f"SELECT ticker, date, {r('e12 / w12', 'ema_12')}, {r('e26 / w26', 'ema_26')} FROM e"))
def _(spark, sf):
    return pick(indicators.debug_emas(market(spark, sf).bars()), "ticker date ema_12 ema_26")


# --- labels --------------------------------------------------------------------------------------------

NAMED = "CASE WHEN target = 1 THEN 'BUY' WHEN target = 0 THEN 'SELL' ELSE 'HOLD' END"


def label_shares(bars: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Flagship: bars to rolling volatility to first-touched barrier to shares of BUY, SELL and HOLD."""
    return labels.label_distribution(labels.named_labels(labels.volatility_barriers(bars, layout)), "label")


@query("label_shares", sql(*TO_LABELS, select=f"SELECT ticker, {NAMED} AS label, count(*) AS n_rows, "
       "round(count(*) / sum(count(*)) OVER (PARTITION BY ticker) + 3.7e-08, 6) + 0.0 AS share FROM barriers GROUP BY 1, 2"))
def _(spark, sf):
    return rounded(label_shares(market(spark, sf).bars()))


@query("volatility_barrier_labels", sql(*TO_LABELS, select=f"SELECT ticker, date, target, {rs('barrier_up barrier_down')}, "
       "'Volatility_Adjusted' AS dynamic_risk_type, 2.5::DOUBLE AS dynamic_risk_k_tp, 1.25::DOUBLE AS dynamic_risk_k_sl, "
       "'rolling_std_20d' AS dynamic_risk_vol_metric FROM barriers"))
def _(spark, sf):
    df = labels.volatility_barriers(market(spark, sf).bars())
    return pick(df, "ticker date target barrier_up barrier_down dynamic_risk_type dynamic_risk_k_tp dynamic_risk_k_sl dynamic_risk_vol_metric")


@query("range_barrier_labels", sql(BARS, STATES, "full_bars AS (SELECT b.*, atr FROM bars b JOIN states USING (ticker, rn))",
       o.barrier_cte("full_bars", "atr"), select="SELECT ticker, date, target, 'atr_14d' AS dynamic_risk_vol_metric FROM barriers"))
def _(spark, sf):
    df = labels.volatility_barriers(market(spark, sf).features(), metric="atr")
    return df.select("ticker", "date", "target", "dynamic_risk_vol_metric")


PERCENT = """
pairs AS (SELECT a.ticker, a.rn, a.date, a.close AS entry, b.rn AS brn, b.date AS bdate, b.close AS bclose
  FROM bars a LEFT JOIN bars b ON a.ticker = b.ticker AND b.rn BETWEEN a.rn + 1 AND a.rn + {rows})"""
PERCENT_LABEL = """SELECT ticker, date, CAST(coalesce(CASE WHEN bdate > date + 10 THEN sign(bclose - entry) WHEN bclose >= entry * 1.01 THEN 1
  WHEN bclose <= entry * (1 - 0.005) THEN -1 END, 0) AS INTEGER) AS label FROM (SELECT * FROM pairs
  QUALIFY row_number() OVER (PARTITION BY ticker, rn ORDER BY CASE WHEN bdate > date + 10 OR bclose >= entry * 1.01 OR bclose <= entry * (1 - 0.005) THEN 0 ELSE 1 END, brn) = 1)"""


@query("percent_barrier_labels", sql(BARS, PERCENT.format(rows=60), select=PERCENT_LABEL))
def _(spark, sf):
    return labels.percent_barriers(market(spark, sf).bars()).select("ticker", "date", "label")


PERCENT_ANY = """any_labels AS (SELECT ticker, date, CAST(CASE WHEN max(bclose) >= any_value(entry) * 1.01 THEN 1 WHEN min(bclose) <= any_value(entry) * (1 - 0.005) THEN -1
  ELSE coalesce(sign(coalesce(arg_min(bclose, brn) FILTER (bdate > date + 10), arg_max(bclose, brn)) - any_value(entry)), 0) END AS INTEGER) AS label
  FROM pairs GROUP BY ticker, rn, date)"""


@query("percent_barrier_labels_any", sql(BARS, PERCENT.format(rows=49), PERCENT_ANY, select="SELECT * FROM any_labels"), dates=("date",))
def _(spark, sf):
    return labels.percent_barriers_any(market(spark, sf).bars()).select("ticker", "date", "label")


@query("percent_label_shares", sql(BARS, PERCENT.format(rows=49), PERCENT_ANY, select="SELECT ticker, label, count(*) AS n_rows, "
       "round(count(*) / sum(count(*)) OVER (PARTITION BY ticker) + 3.7e-08, 6) + 0.0 AS share FROM any_labels GROUP BY ticker, label"))
def _(spark, sf):
    return rounded(labels.label_distribution(labels.percent_barriers_any(market(spark, sf).bars()), "label"))


# --- folds -----------------------------------------------------------------------------------------------

def _counts(spark, sf) -> DataFrame:
    return market(spark, sf).labelled().groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows"))


RANGE = "ticker, fold, CAST(train_lo AS BIGINT) AS train_lo, CAST(train_hi AS BIGINT) AS train_hi, CAST(test_lo AS BIGINT) AS test_lo, CAST(test_hi AS BIGINT) AS test_hi"


@query("fold_ranges_sliding", sql(*TO_LABELS, o.LABELLED, o.FOLDS, select=f"SELECT {RANGE} FROM ranges"))
def _(spark, sf):
    return folds.fold_table(_counts(spark, sf))


@query("fold_ranges_purged", sql(*TO_LABELS, o.LABELLED, o.PURGED, select=f"SELECT {RANGE} FROM ranges"))
def _(spark, sf):
    return folds.fold_table(_counts(spark, sf), scheme="purged")


@query("rows_after_folds", sql(*TO_FOLDS, select="""SELECT l.ticker, any_value(total) AS n_rows, count(fold) AS n_folds,
  any_value(total) - coalesce(max(test_hi), 0) AS rows_after FROM (SELECT DISTINCT ticker, total FROM labelled) l LEFT JOIN ranges USING (ticker) GROUP BY l.ticker"""))
def _(spark, sf):
    return folds.rows_after_folds(market(spark, sf).labelled())


@query("rows_after_folds_purged", sql(*TO_LABELS, o.LABELLED, o.PURGED, select="""SELECT l.ticker, any_value(total) AS n_rows, count(fold) AS n_folds,
  any_value(total) - coalesce(max(test_hi), 0) AS rows_after FROM (SELECT DISTINCT ticker, total FROM labelled) l LEFT JOIN ranges USING (ticker) GROUP BY l.ticker"""))
def _(spark, sf):
    return folds.rows_after_folds(market(spark, sf).labelled(), scheme="purged")


AS_OF, AS_OF_DAYS = "2000-06-30", 1460


@query("fold_ranges_of_lookback", sql(
    o.bars_cte(days=f"date BETWEEN DATE '{AS_OF}' - {AS_OF_DAYS} AND DATE '{AS_OF}'"), ROLL, STATES, BARRIERS, o.LABELLED, o.FOLDS,
    select=f"SELECT {RANGE} FROM ranges"))
def _(spark, sf):
    recent = mk.Market(spark, sf, root=stage_root, as_of=AS_OF, days=AS_OF_DAYS)
    return folds.fold_table(recent.labelled().groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows")))


@query("fold_members_sliding", sql(*TO_FOLDS, select="SELECT ticker, fold, role, date, rn FROM members"))
def _(spark, sf):
    return market(spark, sf).members().select("ticker", "fold", "role", "date", "rn")


REASON = """SELECT ticker, fold, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'val') AS n_val,
  count(DISTINCT CASE WHEN role = 'val' THEN target END) AS n_classes, CASE WHEN count(*) FILTER (role = 'train') < 252 THEN 'insufficient_train_size'
  WHEN count(*) FILTER (role = 'val') < 60 THEN 'insufficient_validation_size'
  WHEN count(DISTINCT CASE WHEN role = 'val' THEN target END) < 2 THEN 'single_validation_class' END AS reason FROM members GROUP BY ticker, fold"""


@query("fold_checks_purged", sql(*TO_LABELS, o.LABELLED, o.PURGED, select=REASON))
def _(spark, sf):
    return folds.expanding_skip_reasons(market(spark, sf).labelled())


@query("class_weights_purged", sql(*TO_LABELS, o.LABELLED, o.PURGED, select="""SELECT ticker, fold, count(*) FILTER (role = 'train' AND target = 0) AS n_sell,
  count(*) FILTER (role = 'train' AND target = 1) AS n_buy, round(coalesce(1.5 * nullif(count(*) FILTER (role = 'train' AND target = 0), 0)
  / nullif(count(*) FILTER (role = 'train' AND target = 1), 0), 1) + 3.7e-08, 6) + 0.0 AS pos_weight FROM members GROUP BY ticker, fold"""))
def _(spark, sf):
    return rounded(folds.expanding_class_weights(market(spark, sf).labelled()))


@query("expanding_moments", sql(*TO_LABELS, o.LABELLED, o.PURGED, select="SELECT ticker, fold, count(*) AS n_train, " + ", ".join(
    f"{r(f'avg({c})', f'mean_{c}')}, {r(f'stddev_pop({c})', f'std_{c}')}" for c in ("volatility_20", "price_to_sma20", "distance_to_ma200")) + " FROM members WHERE role = 'train' GROUP BY ticker, fold"))
def _(spark, sf):
    return rounded(folds.expanding_statistics(market(spark, sf).labelled(), mk.MODEL_FEATURES).drop("n_sell", "n_buy"))


@query("class_weights", sql(*TO_FOLDS, select="""SELECT ticker, fold, count(*) FILTER (role = 'train' AND target = 0) AS n_sell,
  count(*) FILTER (role = 'train' AND target = 1) AS n_buy, round(coalesce(1.5 * nullif(count(*) FILTER (role = 'train' AND target = 0), 0)
  / nullif(count(*) FILTER (role = 'train' AND target = 1), 0), 1) + 3.7e-08, 6) + 0.0 AS pos_weight FROM members GROUP BY ticker, fold"""))
def _(spark, sf):
    return rounded(folds.class_weights(market(spark, sf).members()))


@query("class_shares", sql(*TO_FOLDS, select="""SELECT ticker, fold, role, target, count(*) AS n_rows,
  round(count(*) / sum(count(*)) OVER (PARTITION BY ticker, fold, role) + 3.7e-08, 6) + 0.0 AS share FROM members GROUP BY ticker, fold, role, target"""))
def _(spark, sf):
    return rounded(labels.label_distribution(market(spark, sf).members(), "target", ("ticker", "fold", "role")))


@query("robust_scaled", sql(*TO_PREDS, select=f"SELECT ticker, fold, role, date, {r('s1', 'price_to_sma20')}, {r('s2', 'distance_to_ma200')} FROM scaled"))
def _(spark, sf):
    return pick(folds.robust_scale(market(spark, sf).members(), mk.SCORED), "ticker fold role date price_to_sma20 distance_to_ma200")


@query("standard_scaled", sql(*TO_FOLDS, """sc AS (SELECT ticker, fold, avg(volatility_20) AS m, stddev_pop(volatility_20) AS s FROM members WHERE role = 'train' GROUP BY ticker, fold)""",
       select=f"SELECT ticker, fold, role, date, {r('(volatility_20 - m) / s', 'volatility_20')} FROM members JOIN sc USING (ticker, fold)"))
def _(spark, sf):
    return pick(folds.standard_scale(market(spark, sf).members(), ["volatility_20"]), "ticker fold role date volatility_20")


@query("validation_scores", sql(*TO_PREDS, select=f"SELECT ticker, fold, date, target, {rs('ret p_raw')}, {r('tvm', 'train_vol_mean')}, {r('tvs', 'train_vol_std')} FROM preds"))
def _(spark, sf):
    return pick(market(spark, sf).predictions(), "ticker fold date target ret p_raw train_vol_mean train_vol_std")


# --- thresholds and signals ----------------------------------------------------------------------------------

def _adjusted_preds(spark, sf) -> DataFrame:
    return signals.volatility_weighted(market(spark, sf).predictions())


def _sized(spark, sf) -> DataFrame:
    preds = _adjusted_preds(spark, sf)
    return signals.open_positions(preds, signals.fold_thresholds(preds))


@query("volatility_weighted_scores", sql(*TO_SIGNALS, select=f"SELECT ticker, fold, date, {r('p')} FROM adj"))
def _(spark, sf):
    return pick(_adjusted_preds(spark, sf), "ticker fold date p")


@query("weight_adjusted_scores", sql(*TO_PREDS, select=f"SELECT ticker, fold, date, {r('least(greatest(p_raw / (volatility_20 / tvm + 1e-8), 0), 1)', 'p')} FROM preds"))
def _(spark, sf):
    weighted = signals.weight_by(market(spark, sf).predictions(), F.col("volatility_20") / F.col("train_vol_mean"))
    return pick(weighted, "ticker fold date p")


CURVE = """
pr0 AS (SELECT ticker, fold, p_raw AS th, sum(target) AS tp, count(*) AS n FROM preds GROUP BY ticker, fold, p_raw),
pr1 AS (SELECT a.ticker, a.fold, a.th, sum(b.tp) / sum(b.n) AS precision, sum(b.tp) / nullif((SELECT sum(tp) FROM pr0 c WHERE c.ticker = a.ticker AND c.fold = a.fold), 0) AS recall
  FROM pr0 a JOIN pr0 b ON a.ticker = b.ticker AND a.fold = b.fold AND b.th >= a.th GROUP BY a.ticker, a.fold, a.th),
pr2 AS (SELECT ticker, fold, th AS threshold, coalesce(lead(precision) OVER w, 1) AS precision, coalesce(lead(recall) OVER w, 0) AS recall FROM pr1 WINDOW w AS (PARTITION BY ticker, fold ORDER BY th)),
pr3 AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-9) AS f1 FROM pr2)"""
PR_COLS = "threshold precision recall f1"


@query("best_f1_thresholds", sql(*TO_PREDS, CURVE, select=f"SELECT ticker, fold, {rs(PR_COLS)} FROM pr3 QUALIFY row_number() OVER (PARTITION BY ticker, fold ORDER BY round(f1, 12) DESC, threshold) = 1"))
def _(spark, sf):
    return pick(signals.best_pr_threshold(market(spark, sf).predictions(), p="p_raw"), f"ticker fold {PR_COLS}")


@query("best_precision_thresholds", sql(*TO_PREDS, CURVE, select=f"SELECT ticker, fold, {rs(PR_COLS)} FROM pr3 WHERE recall >= 0.25 QUALIFY row_number() OVER (PARTITION BY ticker, fold ORDER BY round(precision, 12) DESC, threshold) = 1"))
def _(spark, sf):
    best = signals.best_pr_threshold(market(spark, sf).predictions(), metric="precision_at_recall", p="p_raw")
    return pick(best, f"ticker fold {PR_COLS}")


STATS = "sharpe objective_score trade_ratio turnover avg_return coverage_penalty"


@query("net_sharpe_thresholds", sql(*TO_SIGNALS, select=f"SELECT ticker, fold, {rs('threshold_buy ' + STATS)}, CAST(coalesce(trades, 0) AS BIGINT) AS n_trades FROM thresholds"))
def _(spark, sf):
    found = signals.search_thresholds(_adjusted_preds(spark, sf)).select("ticker", "fold", F.col("threshold_buy").alias("th"), "stats.*")
    found = found.withColumns({"threshold_buy": F.col("th"), "n_trades": F.coalesce("n_trades", F.lit(0).cast("long"))})
    return pick(found, f"ticker fold threshold_buy {STATS} n_trades")


GRID_STEPS = "[0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75]"


@query("net_sharpe_thresholds_grid", sql(*TO_PREDS, o.signals_cte().replace(
    "list_distinct(quantile_cont(p, [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]))", f"CAST({GRID_STEPS} AS DOUBLE[])"
).replace("GROUP BY ticker, fold),\npos AS", "GROUP BY ticker, fold),\npos AS").replace(" AND trade_ratio <= 0.22", ""),
    select=f"SELECT ticker, fold, {rs('threshold_buy ' + STATS)} FROM thresholds"))
def _(spark, sf):
    free = Settings(search_mode="grid", risk_profile="balanced")
    found = signals.search_thresholds(_adjusted_preds(spark, sf), s=free).select("ticker", "fold", F.col("threshold_buy").alias("th"), "stats.*")
    return pick(found.withColumn("threshold_buy", F.col("th")), f"ticker fold threshold_buy {STATS}")


FINAL = "vol_z bear_ratio adaptive_buy adaptive_sell smooth_buy smooth_sell final_buy"


@query("smoothed_thresholds", sql(*TO_SIGNALS, select=f"SELECT ticker, fold, {rs(FINAL)} FROM thresholds"))
def _(spark, sf):
    return pick(signals.fold_thresholds(_adjusted_preds(spark, sf)), f"ticker fold {FINAL}")


@query("threshold_signals", sql(*TO_PREDS, select="SELECT ticker, fold, date, CASE WHEN p_raw <= 0.35 THEN -1 WHEN p_raw >= 0.65 THEN 1 ELSE 0 END AS signal FROM preds"))
def _(spark, sf):
    df = signals.threshold_signal(market(spark, sf).predictions(), F.lit(0.65), p="p_raw")
    return signals.short_leg(df, F.lit(0.35), p="p_raw").select("ticker", "fold", "date", "signal")


@query("percentile_signals", sql(*TO_PREDS, select="SELECT ticker, fold, date, CASE WHEN p_raw >= quantile_cont(p_raw, 0.8) OVER (PARTITION BY ticker, fold) THEN 1 ELSE 0 END AS signal FROM preds"))
def _(spark, sf):
    return signals.percentile_signal(market(spark, sf).predictions(), p="p_raw").select("ticker", "fold", "date", "signal")


@query("sized_positions", sql(*TO_SIGNALS, select=f"SELECT ticker, fold, date, signal, rejected, relaxed, {rs('used_buy size')} FROM sized"))
def _(spark, sf):
    return pick(_sized(spark, sf), "ticker fold date signal rejected relaxed used_buy size")


REJECTED = ("threshold_rejected percentile_rejected technical_rejected raw_buy_candidates regime_gate_rejected confidence_rejected "
            "post_filters_buy_signals threshold_relaxed")


@query("rejection_counts", sql(*TO_RESULTS, select=f"SELECT ticker, fold, {', '.join(REJECTED.split())} FROM results"))
def _(spark, sf):
    return signals.rejection_counts(_sized(spark, sf)).select("ticker", "fold", *REJECTED.split())


@query("sizing_summary", sql(*TO_SIGNALS, select="""SELECT ticker, fold, count(*) FILTER (signal = 1) AS n_candidates, count(*) FILTER (unc) AS n_skipped_uncertain,
  count(*) FILTER (low) AS n_skipped_low_conf, count(*) FILTER (size > 0) AS n_sized, round(coalesce(avg(size) FILTER (size > 0), 0) + 3.7e-08, 6) + 0.0 AS avg_size FROM sized GROUP BY ticker, fold"""))
def _(spark, sf):
    return rounded(signals.sizing_summary(_sized(spark, sf)))


@query("signal_counts", sql(*TO_PREDS, select="""SELECT ticker, count(*) FILTER (p_raw > 0.65) AS buy_signals, count(*) FILTER (p_raw < 0.35) AS sell_signals,
  count(*) FILTER (p_raw BETWEEN 0.35 AND 0.65) AS hold_signals FROM preds GROUP BY ticker"""))
def _(spark, sf):
    return signals.signal_counts(market(spark, sf).predictions(), trading_mode="long_short")


@query("signal_marks", sql(*TO_PREDS, select=f"SELECT ticker, fold, date, CASE WHEN p_raw > 0.65 THEN 'BUY' ELSE 'SELL' END AS mark, {r('close')} FROM preds WHERE p_raw > 0.65 OR p_raw < 0.35"))
def _(spark, sf):
    return pick(signals.signal_marks(market(spark, sf).predictions()), "ticker fold date mark close")


# --- evaluation and backtest ------------------------------------------------------------------------------------

@query("ranking_quality", sql(*TO_RESULTS, select=f"SELECT ticker, fold, {rs('auc aucpr')} FROM results"))
def _(spark, sf):
    preds = _adjusted_preds(spark, sf)
    return rounded(evaluation.roc_auc(preds).join(evaluation.average_precision(preds), ["ticker", "fold"]))


@query("calibration_quality", sql(*TO_PREDS, """edges AS (SELECT i, i / 10.0::DOUBLE AS lo, (i + 1) / 10.0::DOUBLE AS hi FROM range(10) t(i)),
bins AS (SELECT ticker, fold, i, count(*) AS n, avg(target) AS acc, avg(p_raw) AS conf FROM preds JOIN edges ON p_raw >= lo AND (p_raw < hi OR (i = 9 AND p_raw <= hi)) GROUP BY ticker, fold, i),
br AS (SELECT ticker, fold, avg((p_raw - target) ** 2) AS brier, count(*) AS total FROM preds GROUP BY ticker, fold)""",
       select="SELECT ticker, fold, round(sum(abs(acc - conf) * n) / any_value(total) + 3.7e-08, 6) + 0.0 AS ece, round(any_value(brier) + 3.7e-08, 6) + 0.0 AS brier FROM bins JOIN br USING (ticker, fold) GROUP BY ticker, fold"))
def _(spark, sf):
    preds = market(spark, sf).predictions()
    return rounded(evaluation.calibration_error(preds, p="p_raw").join(evaluation.brier_score(preds, p="p_raw"), ["ticker", "fold"]))


CONDITIONS = ("buy_share sell_share val_vol_zscore_mean val_vol_zscore_std distance_to_ma200_mean pct_below_ma200_gt_2pct signal_midzone_ratio "
              "mean_probability std_probability")


@query("market_conditions", sql(*TO_SIGNALS, f"""mc AS (SELECT ticker, fold, avg(CASE WHEN target = 1 THEN 1.0 ELSE 0 END) AS buy_share, avg(CASE WHEN target = 0 THEN 1.0 ELSE 0 END) AS sell_share,
  avg((volatility_20 - tvm) / (tvs + 1e-9)) AS val_vol_zscore_mean, stddev_pop((volatility_20 - tvm) / (tvs + 1e-9)) AS val_vol_zscore_std, avg(distance_to_ma200) AS distance_to_ma200_mean,
  avg(CASE WHEN distance_to_ma200 < -0.02 THEN 1.0 ELSE 0 END) AS pct_below_ma200_gt_2pct, avg(CASE WHEN p BETWEEN 0.45 AND 0.55 THEN 1.0 ELSE 0 END) AS signal_midzone_ratio,
  avg(p) AS mean_probability, stddev_pop(p) AS std_probability, count(*) FILTER (signal = 1) AS opened_positions, count(*) FILTER (size > 0) AS sized_positions FROM sized GROUP BY ticker, fold)""",
       select=f"SELECT ticker, fold, {rs(CONDITIONS)}, opened_positions, sized_positions FROM mc"))
def _(spark, sf):
    df = evaluation.market_conditions(market(spark, sf).members(), _sized(spark, sf))
    return pick(df, f"ticker fold {CONDITIONS} opened_positions sized_positions")


@query("trading_costs", sql(*TO_RESULTS, select=f"SELECT ticker, fold, date, {r('tn', 'turnover')}, {rs('gross net')}, {r('least(dd, 0)', 'drawdown')} FROM costs"))
def _(spark, sf):
    df = backtest.drawdown(backtest.with_costs(_sized(spark, sf)), "gross")
    return pick(df.withColumn("drawdown", F.least("drawdown", F.lit(0.0))), "ticker fold date turnover gross net drawdown")


@query("net_metrics", sql(*TO_RESULTS, select=f"SELECT ticker, fold, {rs('net_sharpe net_return turnover')} FROM results"))
def _(spark, sf):
    return rounded(backtest.net_metrics(backtest.with_costs(_sized(spark, sf))))


FOLD_COLS = ("auc aucpr accuracy accuracy_thresholded sharpe max_drawdown sharpe_thresholded precision recall f1 threshold_buy fold_total_return "
             "net_return net_sharpe turnover fold_win_rate trade_coverage ev_mean_fold trade_ratio_at_threshold")
FOLD_COUNTS = f"n_val n_train wins losses avoided_losses fold_trades n_trades_at_threshold {REJECTED} reason"


@query("fold_results", sql(*TO_RESULTS, select=f"SELECT ticker, fold, {rs(FOLD_COLS)}, {', '.join(FOLD_COUNTS.split())} FROM results"))
def _(spark, sf):
    return pick(backtest.fold_results(_sized(spark, sf)), f"ticker fold {FOLD_COLS} {FOLD_COUNTS}")


RUN_COLS = ("coverage_ratio accuracy precision recall f1 auc auc_pr sharpe_thresholded_mean threshold_buy_mean sharpe_ratio net_sharpe max_drawdown "
            "trade_coverage ev_mean_fold accuracy_std auc_std auc_pr_std sharpe_thresholded_std total_return net_return turnover median_fold_trades "
            "worst_fold_auc worst_fold_aucpr win_rate")
RUN_COUNTS = "n_folds_valid n_folds_configured n_folds_skipped n_long_signals_raw n_long_signals_post_filters test_size min_fold_trades train_size"


@query("cross_fold_metrics", sql(*TO_RUNS, select=f"SELECT ticker, {rs(RUN_COLS)}, {', '.join(RUN_COUNTS.split())} FROM runs"))
def _(spark, sf):
    return pick(backtest.cross_fold_metrics(backtest.fold_results(_sized(spark, sf))), f"ticker {RUN_COLS} {RUN_COUNTS}")


@query("fold_accounting", sql(*TO_LABELS, o.LABELLED, o.PURGED, f"checks AS ({REASON})", select="""SELECT ticker, count(*) FILTER (reason IS NULL) AS n_folds_valid,
  count(*) FILTER (reason IS NOT NULL) AS n_folds_skipped, count(*) AS n_folds_total, coalesce(string_agg(reason, ',' ORDER BY fold) FILTER (reason IS NOT NULL), '') AS skip_reasons FROM checks GROUP BY ticker"""))
def _(spark, sf):
    checks = folds.expanding_skip_reasons(market(spark, sf).labelled())
    out = backtest.fold_accounting(checks.filter("reason is null"), checks.filter("reason is not null"))
    return out.withColumn("skip_reasons", F.array_join("skip_reasons", ","))


@query("volatility_regime_rows", sql(*TO_PREDS, select="SELECT ticker, fold, role, date, coalesce(rolling_volatility_zscore > 1.0, false) AS high_vol FROM scaled"))
def _(spark, sf):
    return evaluation.high_volatility(folds.usable(market(spark, sf).members())).select("ticker", "fold", "role", "date", "high_vol")


@query("expected_values", sql(*TO_RESULTS, select=f"SELECT ticker, fold, date, {r('ev', 'expected_value')} FROM costs"))
def _(spark, sf):
    return pick(backtest.expected_values(_adjusted_preds(spark, sf)).withColumnRenamed("ev", "expected_value"), "ticker fold date expected_value")


@query("strategy_curve", sql(*TO_PREDS, """br AS (SELECT ticker, rn, 100 * (close / lag(close) OVER (PARTITION BY ticker ORDER BY rn) - 1) AS bar_return FROM labelled),
sc AS (SELECT p.ticker, p.fold, p.date, p.rn, bar_return, coalesce(CASE WHEN p_raw > 0.55 THEN lead(bar_return) OVER w WHEN p_raw < 0.45 THEN -lead(bar_return) OVER w ELSE 0 END, 0) AS sr
  FROM preds p JOIN br USING (ticker, rn) WINDOW w AS (PARTITION BY p.ticker, p.fold ORDER BY p.rn))""",
       select=f"SELECT ticker, fold, date, {r('sr', 'strategy_return')}, {r('sum(sr) OVER w', 'cum_strategy')}, {r('sum(bar_return) OVER w', 'cum_hold')} FROM sc WINDOW w AS (PARTITION BY ticker, fold ORDER BY rn)"))
def _(spark, sf):
    return pick(backtest.strategy_curve(market(spark, sf).predictions()), "ticker fold date strategy_return cum_strategy cum_hold")


# --- recommendation --------------------------------------------------------------------------------------------------

LATEST = """
lastbar AS (SELECT ticker, arg_max(close, rn) AS last_price, max(date) AS last_date, arg_max(volatility_20, rn) FILTER (volatility_20 IS NOT NULL) AS volatility FROM rolling GROUP BY ticker),
future AS (SELECT ticker, fold, arg_max(p_raw, rn) AS probability FROM preds GROUP BY ticker, fold),
ens AS (SELECT ticker, count(fold) AS n_models, coalesce(avg(probability), 0.5) AS avg_prob, coalesce(max(probability), 0.5) AS max_prob, coalesce(min(probability), 0.5) AS min_prob,
  least(greatest(1 - 4 * stddev_pop(probability), 0), 1) AS recommendation_quality FROM lastbar LEFT JOIN future USING (ticker) GROUP BY ticker),
lev AS (SELECT *, last_price + 2.5 * volatility AS profit_target, last_price - 1.25 * volatility AS stop_loss FROM ens JOIN lastbar USING (ticker)),
ev AS (SELECT *, (profit_target - last_price) / last_price AS tp_pct, (stop_loss - last_price) / last_price AS sl_pct FROM lev),
ev2 AS (SELECT *, avg_prob * tp_pct - (1 - avg_prob) * abs(sl_pct) - 0.0025 AS expected_value, least(1, greatest(0, (avg_prob - 0.68) / 0.32)) AS q FROM ev)"""


def _future(spark, sf) -> tuple[DataFrame, DataFrame]:
    m = market(spark, sf)
    last = recommendation.latest_bar(m.features())
    return recommendation.latest_fold_probability(m.predictions(), last), last


def _recommended(spark, sf) -> DataFrame:
    future, last = _future(spark, sf)
    return recommendation.recommend(recommendation.ensemble_summary(future, last), last)


@query("latest_fold_probabilities", sql(*TO_PREDS, LATEST, select="SELECT ticker, fold, probability, last_date FROM future JOIN lastbar USING (ticker)"))
def _(spark, sf):
    return _future(spark, sf)[0].select("ticker", "fold", "probability", "last_date")


@query("ensemble_summary", sql(*TO_PREDS, LATEST, select=f"""SELECT ticker, n_models, {rs('avg_prob max_prob min_prob recommendation_quality')}, {r('max_prob - min_prob', 'spread')},
  CASE WHEN max_prob - min_prob < 0.1 THEN 'High' WHEN max_prob - min_prob < 0.2 THEN 'Moderate' ELSE 'Low' END AS consensus FROM ens"""))
def _(spark, sf):
    future, last = _future(spark, sf)
    return rounded(recommendation.ensemble_summary(future, last))


@query("recommendations", sql(*TO_PREDS, LATEST, select=f"""SELECT ticker, last_date, {rs('last_price volatility profit_target stop_loss tp_pct sl_pct expected_value')},
  CASE WHEN expected_value <= 0.001 OR avg_prob < 0.68 THEN 'WATCHLIST' WHEN q >= 0.7 THEN 'ENTER_FULL' WHEN q >= 0.35 THEN 'ENTER_SMALL' ELSE 'WATCHLIST' END AS state,
  CASE WHEN expected_value <= 0.001 THEN 'non_positive_ev' WHEN avg_prob < 0.68 THEN 'below_dynamic_threshold' WHEN q >= 0.7 THEN 'high_confidence_positive_ev'
    WHEN q >= 0.35 THEN 'moderate_confidence_positive_ev' ELSE 'low_margin_positive_ev' END AS reason,
  round(CASE WHEN expected_value <= 0.001 OR avg_prob < 0.68 THEN greatest(0, avg_prob - 0.5) ELSE q END + 3.7e-08, 6) + 0.0 AS quality,
  CASE WHEN avg_prob > 0.65 THEN 'BUY' WHEN avg_prob < 0.35 THEN 'AVOID' ELSE 'HOLD' END AS advice FROM ev2"""))
def _(spark, sf):
    return pick(_recommended(spark, sf), "ticker last_date last_price volatility profit_target stop_loss tp_pct sl_pct expected_value state reason quality advice")


@query("row_decisions", sql(*TO_PREDS, f"""rd0 AS (SELECT *, 2.5 * volatility_20 / close AS tp, -1.25 * volatility_20 / close AS sl, volatility_20 <= tvm + 2 * tvs AS allowed FROM preds),
rd1 AS (SELECT *, p_raw * tp - (1 - p_raw) * abs(sl) - 0.0025 AS ev, least(1, greatest(0, (p_raw - 0.62) / 0.38)) AS q FROM rd0)""",
       select=f"""SELECT ticker, fold, date, {r('ev', 'expected_value')}, CASE WHEN NOT allowed THEN 'NO_TRADE' WHEN ev <= 0 OR p_raw < 0.62 THEN 'WATCHLIST' WHEN q >= 0.7 THEN 'ENTER_FULL'
  WHEN q >= 0.35 THEN 'ENTER_SMALL' ELSE 'WATCHLIST' END AS state FROM rd1"""))
def _(spark, sf):
    vol = F.col("volatility_20")
    decision = recommendation.decide(
        F.col("p_raw"), F.lit(0.62), 2.5 * vol / F.col("close"), -1.25 * vol / F.col("close"), Settings().trade_cost,
        allowed=vol <= F.col("train_vol_mean") + 2 * F.col("train_vol_std"),
    )
    df = market(spark, sf).predictions().withColumn("d", decision).select("ticker", "fold", "date", "d.*")
    return pick(df, "ticker fold date expected_value state")


@query("recommendation_payload", sql(*TO_PREDS, LATEST, select=f"SELECT ticker, {r('100 * tp_pct', 'target_pct')}, {r('100 * sl_pct', 'stop_pct')}, round(last_price, 2)::DOUBLE AS entry, 'rolling_std_20d' AS vol_metric FROM ev2"))
def _(spark, sf):
    df = recommendation.payload(_recommended(spark, sf))
    text = F.col("payload")
    return rounded(df.select(
        "ticker", "target_pct", "stop_pct", F.round(F.get_json_object(text, "$.entry").cast("double"), 2).alias("entry"),
        F.get_json_object(text, "$.dynamic_risk.params.vol_metric").alias("vol_metric"),
    ))


@query("forecast_ladder", sql(*TO_PREDS, LATEST, select="""SELECT ticker, CAST(h AS INTEGER) AS h, last_date + CAST(h AS INTEGER) AS date,
  round(last_price * (1 + ((CASE WHEN avg_prob > 0.5 THEN profit_target ELSE stop_loss END) - last_price) / last_price * (1 - exp(-3 * h / 20)) * (0.5 + abs(avg_prob - 0.5))) + 3.7e-08, 6) + 0.0 AS forecast_price,
  round(least(greatest(avg_prob - avg_prob * 0.1 * (h - 1) / 19, 0), 1) + 3.7e-08, 6) + 0.0 AS forecast_probability FROM ev2, range(1, 21) t(h)"""))
def _(spark, sf):
    return rounded(recommendation.forecast_ladder(_recommended(spark, sf)))


# --- settings compared over runs ------------------------------------------------------------------------------------------

_values = ", ".join(
    f"('{c[0]}', '{e}', {2 * i + j}, {c[1]}, {c[2]}, {c[3]}, {c[4]}, '{c[5]}', {c[6] / 100:.2f})" for i, c in enumerate(CANDIDATES) for j, e in enumerate(ENCODERS)
)
_fixed = lambda e, name: f"round({e} + 3.7e-08, 6) + 0.0 AS {name}"
_n3 = "c00 * (c11 * c22 - c12 * c12) - c01 * (c01 * c22 - c12 * c02) + c02 * (c01 * c12 - c11 * c02)"
_k3 = (f"(d0 * (c11 * c22 - c12 * c12) - c01 * (d1 * c22 - c12 * d2) + c02 * (d1 * c12 - c11 * d2)) / ({_n3})",
       f"(c00 * (d1 * c22 - c12 * d2) - d0 * (c01 * c22 - c12 * c02) + c02 * (c01 * d2 - d1 * c02)) / ({_n3})",
       f"(c00 * (c11 * d2 - d1 * c12) - c01 * (c01 * d2 - d1 * c02) + d0 * (c01 * c12 - c11 * c02)) / ({_n3})")
_k2 = ("(d0 * c11 - c01 * d1) / (c00 * c11 - c01 * c01)", "(c00 * d1 - d0 * c01) / (c00 * c11 - c01 * c01)")
_causal = " + ".join(f"avg(ret) OVER {o.frame(n)}" for n in (2, 4, 8, 16))
_model = "fold, encoder_mode, seed"


def _grid_newton(k: int) -> str:
    return f"""n{k + 1} AS MATERIALIZED (SELECT {_model}, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM (
  SELECT {_model}, any_value(a) AS a, any_value(b) AS b, sum((n * q - y) * p) + any_value(a) AS ga, sum(n * q - y) AS gb,
    sum(n * q * (1 - q) * p * p) + 1 AS haa, sum(n * q * (1 - q) * p) AS hab, sum(n * q * (1 - q)) AS hbb
  FROM (SELECT *, 1 / (1 + exp(-(a * p + b))) AS q FROM gpts JOIN n{k} USING ({_model})) GROUP BY {_model}))"""


# Least squares per fold, encoder and seed by Cramer's rule; then both calibrations of every model's scores.
GRID = f"""
tcn AS (SELECT ticker, rn AS bar_rn, ({_causal}) / 4 AS x3 FROM (SELECT ticker, rn, coalesce(close / {o.lag('close')} - 1, lead(close) OVER (PARTITION BY ticker ORDER BY rn) / close - 1) AS ret FROM bars)),
gm AS MATERIALIZED (SELECT m.*, x3 FROM scaled m JOIN tcn USING (ticker, bar_rn)),
mom AS (SELECT fold, seed, avg(target) AS my, avg(s1) AS m0, avg(s2) AS m1, avg(x3) AS m2, covar_pop(s1, s1) AS c00, covar_pop(s1, s2) AS c01, covar_pop(s1, x3) AS c02,
  covar_pop(s2, s2) AS c11, covar_pop(s2, x3) AS c12, covar_pop(x3, x3) AS c22, covar_pop(s1, target) AS d0, covar_pop(s2, target) AS d1, covar_pop(x3, target) AS d2
  FROM gm, (VALUES {", ".join(f"({x})" for x in BENCHMARK_SEEDS)}) t(seed)
  WHERE role = 'train' AND (rn * 7919 + seed * 104729 + ascii(ticker) * 31 + ascii(substr(ticker, 2, 1)) * 17) % 1000 < 850 GROUP BY fold, seed),
slopes AS (SELECT fold, seed, my, m0, m1, m2, 'off' AS encoder_mode, {_fixed(_k2[0], 'b1')}, {_fixed(_k2[1], 'b2')}, 0.0::DOUBLE AS b3 FROM mom
  UNION ALL SELECT fold, seed, my, m0, m1, m2, 'tcn', {_fixed(_k3[0], 'b1')}, {_fixed(_k3[1], 'b2')}, {_fixed(_k3[2], 'b3')} FROM mom),
lin AS MATERIALIZED (SELECT *, {_fixed('my - b1 * m0 - b2 * m1 - b3 * m2', 'b0')} FROM slopes),
gh AS (SELECT *, row_number() OVER (PARTITION BY ticker, fold ORDER BY rn) AS k, count(*) OVER (PARTITION BY ticker, fold) AS n FROM gm WHERE role = 'train'),
gheld AS (SELECT *, count(*) OVER g AS m, min(target) OVER g AS lo, max(target) OVER g AS hi FROM gh WHERE n >= 100 AND k > floor(n * 0.8) WINDOW g AS (PARTITION BY ticker, fold)),
gpts AS MATERIALIZED (SELECT {_model}, p, sum(target) AS y, count(*) AS n, row_number() OVER (PARTITION BY {_model} ORDER BY p) AS i FROM (
  SELECT h.fold, encoder_mode, seed, target, {_fixed('1 / (1 + exp(-4 * (b0 + b1 * s1 + b2 * s2 + b3 * x3 - 0.5)))', 'p')} FROM gheld h JOIN lin USING (fold) WHERE m >= 30 AND lo < hi) GROUP BY {_model}, p),
n0 AS (SELECT DISTINCT {_model}, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM gpts),{",".join(map(_grid_newton, range(12)))},
gspans AS (SELECT a.fold, a.encoder_mode, a.seed, a.i AS i, b.i AS j, sum(b.y) OVER w / sum(b.n) OVER w AS mean FROM gpts a JOIN gpts b
  ON a.fold = b.fold AND a.encoder_mode = b.encoder_mode AND a.seed = b.seed AND b.i >= a.i WINDOW w AS (PARTITION BY a.fold, a.encoder_mode, a.seed, a.i ORDER BY b.i ROWS UNBOUNDED PRECEDING)),
gends AS (SELECT {_model}, i, j, min(mean) OVER (PARTITION BY {_model}, i ORDER BY j DESC ROWS UNBOUNDED PRECEDING) AS low FROM gspans),
giso AS MATERIALIZED (SELECT {_model}, p, v FROM (SELECT {_model}, j AS i, max(low) AS v FROM gends GROUP BY {_model}, j) JOIN gpts USING ({_model}, i)),
gval AS MATERIALIZED (SELECT p.* EXCLUDE (p_raw), x3, encoder_mode, seed, {_fixed('1 / (1 + exp(-4 * (b0 + b1 * s1 + b2 * s2 + b3 * x3 - 0.5)))', 'pm')}
  FROM preds p JOIN tcn USING (ticker, bar_rn) JOIN lin USING (fold)),
gline AS (SELECT q.*, lo.p AS pa, lo.v AS va FROM (SELECT DISTINCT {_model}, pm FROM gval) q ASOF LEFT JOIN giso lo ON q.fold = lo.fold AND q.encoder_mode = lo.encoder_mode AND q.seed = lo.seed AND q.pm >= lo.p),
gline2 AS (SELECT q.*, hi.p AS pb, hi.v AS vb FROM gline q ASOF LEFT JOIN giso hi ON q.fold = hi.fold AND q.encoder_mode = hi.encoder_mode AND q.seed = hi.seed AND q.pm <= hi.p),
gcal AS MATERIALIZED (SELECT g.*, {_fixed('least(greatest(CASE WHEN pa IS NULL THEN vb WHEN pb IS NULL OR pa = pb THEN va ELSE va + (vb - va) * (pm - pa) / (pb - pa) END, 1e-6), 1 - 1e-6)', 'pi')},
  {_fixed('least(greatest(1 / (1 + exp(-((round(a + 3.7e-08, 6) + 0.0) * pm + (round(b + 3.7e-08, 6) + 0.0)))), 1e-6), 1 - 1e-6)', 'ps')}
  FROM gval g LEFT JOIN gline2 USING ({_model}, pm) LEFT JOIN n12 USING ({_model})),
settings(candidate_id, encoder_mode, setting_no, target_coverage, trade_ratio_floor, th_min, th_max, method, pct) AS (VALUES {_values}),
grid AS MATERIALIZED (SELECT g.* EXCLUDE (pi, ps, pm), s.* EXCLUDE (encoder_mode, method), coalesce(CASE WHEN method = 'isotonic' THEN pi ELSE ps END, pm) AS p_raw FROM gcal g JOIN settings s USING (encoder_mode))"""
RUN_KEYS = "candidate_id, encoder_mode, seed, "
TO_GRID = (*TO_PREDS, GRID, o.signals_cte("grid", RUN_KEYS, "th_min", "th_max", "trade_ratio_floor", "target_coverage", "pct", 10),
           o.results_cte(RUN_KEYS), o.cross_cte(RUN_KEYS),
           """scored_runs AS MATERIALIZED (SELECT *, n_folds_valid / n_folds_configured AS valid_folds_ratio,
  0.60 * net_sharpe + 0.30 * coverage_ratio + 0.15 * auc - 0.01 * turnover AS score FROM runs)""")


def _summary_sql(keys: str, source: str, more: str = "") -> str:
    parts = ", ".join(f"avg({c}) AS {n}_mean, stddev_samp({c}) AS {n}_std" for c, n in (("score", "score"), ("net_sharpe", "net_sharpe"), ("coverage_ratio", "coverage")))
    return f"""SELECT *, score_mean - 0.5 * coalesce(score_std, 0) AS robust_score, net_sharpe_mean - 0.5 * coalesce(net_sharpe_std, 0) AS robust_net_sharpe FROM (
  SELECT {keys}, {parts}, avg(auc) AS auc_mean, avg(accuracy) AS accuracy_mean, avg(turnover) AS turnover_mean, avg(valid_folds_ratio) AS valid_folds_ratio_mean, count(*) AS runs{more} FROM {source} GROUP BY {keys})"""


COMBOS = f"combos AS MATERIALIZED ({_summary_sql('candidate_id, ticker, encoder_mode', 'scored_runs')})"
CHOSEN = """
duel AS (SELECT candidate_id, ticker, max(robust_score) FILTER (encoder_mode = 'tcn') - max(robust_score) FILTER (encoder_mode = 'off') AS dr,
  max(net_sharpe_mean) FILTER (encoder_mode = 'tcn') - max(net_sharpe_mean) FILTER (encoder_mode = 'off') AS dn, count(*) FILTER (encoder_mode = 'off') AS no, count(*) FILTER (encoder_mode = 'tcn') AS nt
  FROM combos GROUP BY candidate_id, ticker),
chosen AS MATERIALIZED (SELECT c.*, CASE WHEN nt = 0 THEN 'only_off_available' WHEN no = 0 THEN 'only_tcn_available' WHEN dr >= 0.02 AND dn >= 0.05 THEN 'tcn_improves_robust_and_net' ELSE 'off_is_more_robust' END AS encoder_selection_reason
  FROM combos c JOIN duel USING (candidate_id, ticker) WHERE encoder_mode = CASE WHEN no = 0 OR (nt > 0 AND dr >= 0.02 AND dn >= 0.05) THEN 'tcn' ELSE 'off' END)"""
FINALS = f"""
sel AS (SELECT * FROM scored_runs SEMI JOIN chosen USING (candidate_id, ticker, encoder_mode)),
finals AS MATERIALIZED ({_summary_sql('candidate_id', 'sel', ', count(DISTINCT ticker) AS tickers')})"""
SUMMARY_COLS = ("score_mean score_std net_sharpe_mean net_sharpe_std coverage_mean coverage_std valid_folds_ratio_mean auc_mean accuracy_mean "
                "turnover_mean robust_score robust_net_sharpe")
PARAM_SQL = "VALUES " + ", ".join(str(c) for c in CANDIDATES)
PARAMS = f"params(id, target_coverage, trade_ratio_floor, conservative_th_min, conservative_th_max, calibration_method, conservative_percentile_threshold) AS ({PARAM_SQL})"


def _bench(spark, sf) -> Benchmark:
    return Benchmark(market(spark, sf))


def _chosen(spark, sf) -> DataFrame:
    return selection.choose_encoders(selection.summarize_combos(_bench(spark, sf).runs()))


@query("benchmark_run_scores", sql(*TO_GRID, select=f"SELECT candidate_id, encoder_mode, CAST(seed AS INTEGER) AS seed, ticker, {rs('auc accuracy net_sharpe coverage_ratio trade_coverage turnover valid_folds_ratio score')} FROM scored_runs"))
def _(spark, sf):
    return pick(_bench(spark, sf).runs(), "candidate_id encoder_mode seed ticker auc accuracy net_sharpe coverage_ratio trade_coverage turnover valid_folds_ratio score")


@query("benchmark_combos", sql(*TO_GRID, COMBOS, PARAMS, select=f"SELECT candidate_id, ticker, encoder_mode, runs, {rs(SUMMARY_COLS)}, calibration_method FROM combos LEFT JOIN params ON candidate_id = id"))
def _(spark, sf):
    combos = selection.with_parameters(selection.summarize_combos(_bench(spark, sf).runs()), candidates(spark))
    return pick(combos, f"candidate_id ticker encoder_mode runs {SUMMARY_COLS} calibration_method")


@query("encoder_choice", sql(*TO_GRID, COMBOS, CHOSEN, select=f"SELECT candidate_id, ticker, encoder_mode, encoder_selection_reason, {rs('robust_score net_sharpe_mean')} FROM chosen"))
def _(spark, sf):
    return pick(_chosen(spark, sf), "candidate_id ticker encoder_mode encoder_selection_reason robust_score net_sharpe_mean")


@query("selected_runs", sql(*TO_GRID, COMBOS, CHOSEN, FINALS, select=f"SELECT candidate_id, encoder_mode, CAST(seed AS INTEGER) AS seed, ticker, {r('score')} FROM sel"))
def _(spark, sf):
    runs = _bench(spark, sf).runs()
    return pick(selection.selected_runs(runs, _chosen(spark, sf)), "candidate_id encoder_mode seed ticker score")


@query("benchmark_summary", sql(*TO_GRID, COMBOS, CHOSEN, FINALS, select=f"SELECT candidate_id, runs, tickers, {rs(SUMMARY_COLS)} FROM finals"))
def _(spark, sf):
    return pick(selection.summarize_candidates(_bench(spark, sf).runs(), _chosen(spark, sf)), f"candidate_id runs tickers {SUMMARY_COLS}")


@query("report_read_back", sql(*TO_GRID, COMBOS, CHOSEN, FINALS, select=f"SELECT candidate_id, runs, tickers, {rs(SUMMARY_COLS)} FROM finals"))
def _(spark, sf):
    path, runs, chosen = _folder(spark, sf), _bench(spark, sf).runs(), _chosen(spark, sf)
    summary = selection.summarize_candidates(runs, chosen)
    selection.write_report(runs, selection.summarize_combos(runs), chosen, summary, selection.choose_best(summary), path)
    return pick(spark.read.schema(summary.schema).json(f"{path}/summary"), f"candidate_id runs tickers {SUMMARY_COLS}")


@query("best_candidate", sql(*TO_GRID, COMBOS, CHOSEN, FINALS, "flagged AS (SELECT *, net_sharpe_mean >= 0 AND coverage_mean >= 0.83 AND valid_folds_ratio_mean >= 0.83 AS ok FROM finals)",
       select=f"SELECT candidate_id, {rs('robust_score net_sharpe_mean coverage_mean')}, NOT ok AS relaxed FROM flagged ORDER BY ok DESC, round(flagged.robust_score, 12) DESC, candidate_id LIMIT 1"))
def _(spark, sf):
    best = selection.choose_best(selection.summarize_candidates(_bench(spark, sf).runs(), _chosen(spark, sf)))
    return pick(best, "candidate_id robust_score net_sharpe_mean coverage_mean relaxed")


@query("candidates_of_tickers", sql(BARS, "n AS (SELECT ticker, count(*) AS n, avg(CASE WHEN close > open THEN 1.0 ELSE 0.0 END) AS up, row_number() OVER (ORDER BY ticker) AS k FROM bars GROUP BY ticker)",
       select="""SELECT CASE WHEN n % 3 = 0 THEN 'candidate_' || k ELSE ticker END AS id, CASE WHEN n % 5 = 0 THEN 0.16 ELSE round(up + 3.7e-06, 4) END AS target_coverage,
  least(0.58 + (n % 7) / 100, 0.6 + (n % 5) / 100) AS conservative_th_min, greatest(0.58 + (n % 7) / 100, 0.6 + (n % 5) / 100) AS conservative_th_max,
  CASE n % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'medium' END AS xgb_candidate_budget FROM n"""))
def _(spark, sf):
    # A JSON list with one candidate per ticker, written and read back: ids, coverage and bounds are missing or reversed for some.
    n = F.col("n")
    bars = market(spark, sf).bars().groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("close") > F.col("open")).cast("double")).alias("up"))
    budget = F.when(n % 4 == 0, "LOW").when(n % 4 == 1, "High").when(n % 4 == 2, "huge")
    fields = {"id": F.when(n % 3 != 0, F.col("ticker")), "target_coverage": F.when(n % 5 != 0, F.round(F.col("up") + 3.7e-06, 4)), "xgb_candidate_budget": budget,
              "conservative_th_min": 0.58 + (n % 7) / 100, "conservative_th_max": 0.6 + (n % 5) / 100}
    rows = bars.groupBy().agg(F.array_sort(F.collect_list(F.struct("ticker", F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("c")))).alias("c"))
    path = _folder(spark, sf)
    rows.select(F.concat(F.lit("["), F.array_join(F.transform("c", lambda x: x["c"]), ",\n"), F.lit("]"))).coalesce(1).write.text(path)
    return pick(candidate_source.read_candidates(spark, path), "id target_coverage conservative_th_min conservative_th_max xgb_candidate_budget")


@query("encoder_votes", sql(*TO_GRID, COMBOS, CHOSEN, "votes AS (SELECT candidate_id, encoder_mode, count(*) AS votes FROM chosen GROUP BY 1, 2)",
       select="SELECT candidate_id, encoder_mode, votes, CAST(sum(votes) OVER (PARTITION BY candidate_id) AS BIGINT) AS n_tickers FROM votes QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY votes DESC, encoder_mode) = 1"))
def _(spark, sf):
    return selection.encoder_vote(_chosen(spark, sf))


@query("encoder_by_ticker", sql(*TO_GRID, COMBOS, CHOSEN, FINALS, "flagged AS (SELECT *, net_sharpe_mean >= 0 AND coverage_mean >= 0.83 AND valid_folds_ratio_mean >= 0.83 AS ok FROM finals)",
       "top AS (SELECT candidate_id FROM flagged ORDER BY ok DESC, round(flagged.robust_score, 12) DESC, candidate_id LIMIT 1)", select="SELECT candidate_id, ticker, encoder_mode FROM chosen SEMI JOIN top USING (candidate_id)"))
def _(spark, sf):
    chosen = _chosen(spark, sf)
    best = selection.choose_best(selection.summarize_candidates(_bench(spark, sf).runs(), chosen))
    return selection.encoder_by_ticker(chosen, best)


# --- run log ------------------------------------------------------------------------------------------------------------------

_used = ("volatility_20", "price_to_sma20", "distance_to_ma200", "s1", "s2")
_named = {"s1": "price_to_sma20_scaled", "s2": "distance_to_ma200_scaled"}
_strong = "[x for x in [" + ", ".join(f"CASE WHEN round(abs(corr({c}, target) FILTER (p_raw >= 0.5)), 6) >= 0.05 THEN '{_named.get(c, c)}' END" for c in _used) + "] if x IS NOT NULL]"
_weak = "[x for x in [" + ", ".join(f"CASE WHEN round(abs(corr({c}, target) FILTER (p_raw >= 0.5)), 6) >= 0.05 THEN NULL ELSE '{_named.get(c, c)}' END" for c in _used) + "] if x IS NOT NULL]"
_seed_no = " ".join(f"WHEN {seed} THEN {i}" for i, seed in enumerate(BENCHMARK_SEEDS))
RECORDS = (*TO_GRID, f"""sig AS (SELECT candidate_id, encoder_mode, seed, ticker, count(*) FILTER (p_raw > 0.65) AS buy_signals, 0::BIGINT AS sell_signals,
  {_strong} AS used, {_weak} AS weak, max(date) FILTER (p_raw >= 0.5) AS run_date FROM grid GROUP BY ALL),
flat AS MATERIALIZED (SELECT row_number() OVER (ORDER BY setting_no, CASE seed {_seed_no} END, r.ticker) AS run_number, r.*, n_folds_valid AS fold, len(used) AS features_count,
  0 AS lstm_dims, used, weak, run_date, buy_signals, sell_signals, auc AS auc_roc FROM scored_runs r JOIN sig USING (candidate_id, encoder_mode, seed, ticker)
  JOIN (SELECT DISTINCT candidate_id, encoder_mode, setting_no FROM settings) USING (candidate_id, encoder_mode))""")
FLAT_COLS = "accuracy auc_roc auc_pr precision recall f1 sharpe_ratio net_sharpe max_drawdown total_return net_return turnover coverage_ratio trade_coverage ev_mean_fold"


def _records(spark, sf) -> DataFrame:
    return _bench(spark, sf).records()


@query("run_log_flat", sql(*RECORDS, select=f"""SELECT run_number, ticker, fold, n_folds_configured AS cv_folds_configured, n_folds_valid AS cv_folds_valid, n_folds_skipped AS cv_folds_skipped,
  features_count, lstm_dims, train_size, test_size, {rs(FLAT_COLS)}, n_long_signals_raw, n_long_signals_post_filters, buy_signals, sell_signals FROM flat"""))
def _(spark, sf):
    return pick(runlog.flatten(_records(spark, sf)), "run_number ticker fold cv_folds_configured cv_folds_valid cv_folds_skipped features_count lstm_dims train_size test_size "
                f"{FLAT_COLS} n_long_signals_raw n_long_signals_post_filters buy_signals sell_signals")


@query("run_log_metadata", sql(*RECORDS, select=f"""SELECT count(*) AS total_runs, {r('greatest(max(auc), 0)', 'best_auc')}, {r('greatest(max(accuracy), 0)', 'best_accuracy')}, {r('max(sharpe_ratio)', 'best_sharpe')},
  {r('max(net_sharpe)', 'best_net_sharpe')}, {r('avg(auc)', 'average_auc')}, {r('avg(accuracy)', 'average_accuracy')}, {r('coalesce(avg(sharpe_ratio), 0)', 'average_sharpe')},
  {r('var_pop(auc)', 'auc_variance')}, {r('var_pop(accuracy)', 'accuracy_variance')} FROM flat"""))
def _(spark, sf):
    return rounded(runlog.metadata(_records(spark, sf)))


@query("feature_usage", sql(*RECORDS, "names AS (SELECT unnest(used) AS feature FROM flat)", select="SELECT feature, count(*) AS n_runs, round(100 * count(*) / (SELECT count(*) FROM flat) + 3.7e-08, 6) + 0.0 AS percent FROM names GROUP BY feature ORDER BY n_runs DESC, feature LIMIT 20"))
def _(spark, sf):
    return rounded(runlog.feature_usage(_records(spark, sf)))


@query("feature_families", sql(*RECORDS, "names AS (SELECT DISTINCT unnest(used) AS feature FROM flat)", select="""SELECT count(*) AS n_features,
  count(*) FILTER (contains(feature, 'lstm_latent')) AS n_latent, count(*) FILTER (NOT contains(feature, 'lstm')) AS n_technical FROM names"""))
def _(spark, sf):
    return runlog.feature_families(_records(spark, sf))


def _folder(spark, sf) -> str:
    """A new folder under the shared root, for what a query writes and reads back."""
    return f"{market(spark, sf).stages.root}/written/{uuid.uuid4().hex}"


BACK_COLS = "accuracy auc_roc sharpe_ratio net_sharpe turnover"
BACK = sql(*RECORDS, select=f"SELECT run_number, ticker, fold, features_count, {rs(BACK_COLS)}, buy_signals FROM flat")


@query("run_log_appended", BACK)
def _(spark, sf):
    path, records = _folder(spark, sf), _records(spark, sf)
    for part in (0, 1):
        runlog.append_records(records.filter(F.col("run_number") % 2 == part), path)
    return pick(runlog.flatten(spark.read.schema(records.schema).parquet(path)), f"run_number ticker fold features_count {BACK_COLS} buy_signals")


@query("run_log_csv", BACK)
def _(spark, sf):
    path, flat = _folder(spark, sf), runlog.flatten(_records(spark, sf))
    runlog.write_csv(flat, path)
    return pick(runlog.read_csv(spark, path, flat.schema), f"run_number ticker fold features_count {BACK_COLS} buy_signals")


@query("run_log_json", BACK)
def _(spark, sf):
    # One document, written and read back by as many tasks as it has blocks.
    path, records = _folder(spark, sf), _records(spark, sf)
    json_log.write_runs(records, path, runlog.metadata(records))
    return pick(runlog.flatten(json_log.read_runs(spark, path, records.schema)), f"run_number ticker fold features_count {BACK_COLS} buy_signals")


@query("features_per_run", sql(*RECORDS, select="SELECT run_number, len(used) AS n_features, 0::BIGINT AS n_latent, len(used) AS n_technical, len(weak) AS n_weak FROM flat"))
def _(spark, sf):
    f = F.col("features")
    return _records(spark, sf).select(
        "run_number", f["count"].cast("long").alias("n_features"), f["lstm_latent_dims"].cast("long").alias("n_latent"),
        f["technical_features"].cast("long").alias("n_technical"), F.size("features_contract.removed_by_importance").cast("long").alias("n_weak"))


@query("best_run", sql(*RECORDS, select=f"SELECT run_number, ticker, {rs('auc_roc accuracy sharpe_ratio')}, buy_signals FROM flat ORDER BY auc_roc DESC, run_number LIMIT 1"))
def _(spark, sf):
    return pick(runlog.best_run(runlog.flatten(_records(spark, sf))), "run_number ticker auc_roc accuracy sharpe_ratio buy_signals")


THREE = ("accuracy", "auc_roc", "sharpe_ratio")


@query("run_statistics", sql(*RECORDS, select=" UNION ALL ".join(
    f"SELECT '{m}' AS metric, {r(f'min({m})', 'min')}, {r(f'max({m})', 'max')}, {r(f'avg({m})', 'mean')}, {r(f'stddev_samp({m})', 'std')} FROM flat" for m in THREE)))
def _(spark, sf):
    return rounded(runlog.run_statistics(runlog.flatten(_records(spark, sf))))


@query("early_vs_recent_runs", sql(*RECORDS, "halves AS (SELECT *, row_number() OVER (ORDER BY run_number) <= (SELECT count(*) // 2 FROM flat) AS early FROM flat)", select=" UNION ALL ".join(
    f"SELECT '{m}' AS metric, {r(f'avg({m}) FILTER (early)', 'early_mean')}, {r(f'stddev_samp({m}) FILTER (early)', 'early_std')}, {r(f'avg({m}) FILTER (NOT early)', 'recent_mean')}, "
    f"{r(f'stddev_samp({m}) FILTER (NOT early)', 'recent_std')}, {r(f'100 * (avg({m}) FILTER (NOT early) - avg({m}) FILTER (early)) / avg({m}) FILTER (early)', 'change_percent')} FROM halves" for m in THREE)))
def _(spark, sf):
    return rounded(runlog.early_vs_recent(runlog.flatten(_records(spark, sf))))


@query("signal_statistics", sql(*RECORDS, select="SELECT " + ", ".join(
    f"CAST(sum({s}_signals) AS BIGINT) AS {s}_total, {r(f'avg({s}_signals)', f'{s}_mean')}, {r(f'stddev_samp({s}_signals)', f'{s}_std')}, min({s}_signals) AS {s}_min, max({s}_signals) AS {s}_max" for s in ("buy", "sell")
) + ", round((sum(buy_signals) + 0.1) / (sum(sell_signals) + 0.1) + 3.7e-08, 6) + 0.0 AS buy_sell_ratio FROM flat"))
def _(spark, sf):
    return rounded(runlog.signal_statistics(runlog.flatten(_records(spark, sf))))


@query("latest_runs", sql(*RECORDS, select=f"SELECT run_number, run_date AS date, ticker, n_folds_valid || '/' || n_folds_configured AS valid_configured, n_folds_skipped AS skipped, {rs('accuracy auc_roc sharpe_ratio max_drawdown')} FROM flat ORDER BY run_number DESC LIMIT 5"))
def _(spark, sf):
    return rounded(runlog.latest_runs(_records(spark, sf)))


@query("all_runs_table", sql(*RECORDS, select=f"SELECT run_number, ticker, fold, {rs('accuracy auc_roc auc_pr sharpe_ratio max_drawdown')}, buy_signals, sell_signals FROM flat"))
def _(spark, sf):
    return rounded(runlog.runs_table(runlog.flatten(_records(spark, sf))))


@query("run_details", sql(*RECORDS, select=f"SELECT run_number, ticker, {r('auc_roc')}, features_count FROM flat WHERE run_number = 7"))
def _(spark, sf):
    return pick(runlog.flatten(runlog.run_details(_records(spark, sf), 7)), "run_number ticker auc_roc features_count")


@query("frozen_baseline", sql(*RECORDS, select=f"SELECT 'v1' AS tag, run_number, ticker, {r('auc_roc')} FROM flat WHERE upper(ticker) = 'AF' ORDER BY run_number DESC LIMIT 1"))
def _(spark, sf):
    none = spark.createDataFrame([], "tag string")
    return rounded(runlog.freeze_baseline(_records(spark, sf), none, "v1", "af").select("tag", "run_number", "ticker", "metrics.auc_roc"))


@query("persistent_low_importance", sql(*RECORDS, "lastfive AS (SELECT run_number FROM flat ORDER BY run_number DESC LIMIT 5)",
       "low AS (SELECT run_number, unnest(weak) AS feature FROM lastfive JOIN flat USING (run_number))",
       select="SELECT feature, count(*) AS n_runs FROM low GROUP BY feature HAVING count(*) >= 3"))
def _(spark, sf):
    return runlog.persistent_low_importance(_records(spark, sf))


# --- profiles and correlations ----------------------------------------------------------------------------------------------------

PROFILE_COLS = ("close", "volume", "volatility_20", "distance_to_ma200", "regime_state")
_long = "UNPIVOT_ROWS AS (" + " UNION ALL ".join(f"SELECT ticker, rn, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM rolling" for c in PROFILE_COLS) + ")"


@query("column_profile", sql(BARS, ROLL, _long, select=f"""SELECT feature, count(value) AS count, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'std')}, {r('min(value)', 'min')}, {r('max(value)', 'max')},
  stddev_samp(value) < 1e-6 AS constant FROM UNPIVOT_ROWS GROUP BY feature"""))
def _(spark, sf):
    return rounded(profile.column_profile(market(spark, sf).features(), PROFILE_COLS))


@query("distinct_values", sql(BARS, select="SELECT 'volume' AS feature, count(DISTINCT volume) AS n_distinct FROM bars UNION ALL SELECT 'high' AS feature, count(DISTINCT high) AS n_distinct FROM bars"))
def _(spark, sf):
    return profile.distinct_values(market(spark, sf).bars(), ["volume", "high"])


@query("last_values", sql(BARS, ROLL, _long, select=f"SELECT ticker, feature, rn, {r('value')} FROM UNPIVOT_ROWS QUALIFY rn > max(rn) OVER (PARTITION BY ticker) - 5"))
def _(spark, sf):
    return rounded(profile.last_values(market(spark, sf).features(), PROFILE_COLS))


@query("feature_drift", sql(BARS, ROLL, "m AS (SELECT *, count(*) OVER (PARTITION BY ticker) AS total FROM rolling)", select=" UNION ALL ".join(
    f"SELECT ticker, '{c}' AS feature, {r(f'avg({c}) FILTER (rn <= 100)', 'first_mean')}, {r(f'avg({c}) FILTER (rn > total - 100)', 'last_mean')}, "
    f"{r(f'abs(avg({c}) FILTER (rn > total - 100) - avg({c}) FILTER (rn <= 100))', 'change')} FROM m GROUP BY ticker" for c in ("close", "volume", "volatility_20"))))
def _(spark, sf):
    return rounded(profile.drift(market(spark, sf).features(), ["close", "volume", "volatility_20"]))


CORR_COLS = ("close", "volume", "vix_close", "volatility_20", "volatility_5", "price_to_sma20", "price_to_sma50", "distance_to_ma200", "roc_10",
             "roc_20", "mfi", "stoch_k", "bb_percent", "volume_ratio", "close_vix_ratio")


def _corr_sql(pairs) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 'r')} FROM rolling" for a, b in pairs)


@query("correlation_matrix", sql(BARS, ROLL, select=_corr_sql([(a, b) for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]])))
def _(spark, sf):
    return rounded(profile.correlation_matrix(market(spark, sf).features(), CORR_COLS))


CORR_LEFT, CORR_RIGHT = ("price_to_sma20", "roc_10", "bb_percent"), ("stoch_k", "price_to_sma50", "mfi", "close")


@query("high_correlations", sql(BARS, ROLL, f"pairs AS ({_corr_sql([(a, b) for a in CORR_LEFT for b in CORR_RIGHT])})", select="SELECT * FROM pairs WHERE abs(r) > 0.7"))
def _(spark, sf):
    return rounded(profile.high_correlations(market(spark, sf).features(), CORR_LEFT, CORR_RIGHT))


# Columns of the feature table that the correlation filter may drop, in table order.
DROPPABLE = (
    "rn vix_filled hlc3 log_returns true_range volatility_5 volume_ma_20 roc_10 roc_20 volume_roc_10 price_momentum_10d vix_change high_low_ratio "
    "close_open_ratio sma_100 ma_200 high_52w low_52w volume_ma_ratio price_to_sma50 price_to_52w_high price_to_52w_low rolling_volatility_zscore "
    "bb_mid bb_lower bb_upper bb_width bb_percent stoch_k regime_state stoch_d regime_change garch_volatility rsi_14 rsi_21 DMP_14 DMN_14 kc_mid "
    "kc_lower kc_upper rsi macdh atr_price_ratio risk_adjusted_momentum"
).split()
_pairs = ", ".join(f"{{'a': '{a}', 'b': '{b}', 'r': corr(\"{a}\", \"{b}\")}}" for i, a in enumerate(DROPPABLE) for b in DROPPABLE[i + 1:])


@query("correlated_features", sql(BARS, ROLL, STATES, """alls AS MATERIALIZED (SELECT r.*, s.* EXCLUDE (ticker, date, rn, close), ema_short AS kc_mid, rsi_14 AS rsi,
  atr / r.close AS atr_price_ratio, price_momentum_10d / (atr / r.close + 1e-8) AS risk_adjusted_momentum FROM rolling r JOIN states s USING (ticker, rn)),
pairs AS (SELECT unnest(["""+ _pairs + """], recursive := true) FROM alls)""", select=f"SELECT a, b, {r('abs(r)', 'r')} FROM pairs WHERE abs(r) > 0.98"))
def _(spark, sf):
    return rounded(contract.correlated_pairs(market(spark, sf).features().select("ticker", "date", *DROPPABLE)))


# --- sequences ----------------------------------------------------------------------------------------------------------------------

SEQ = f"""
q0 AS (SELECT ticker, date, rn, close, close / {o.lag('close')} - 1 AS ret, ln(close / {o.lag('close')}) AS lr, close - {o.lag('close')} AS step, avg(close) OVER {o.frame(20)} AS ma FROM bars),
q1 AS (SELECT *, CASE WHEN step > 0 THEN step ELSE 0 END AS up, CASE WHEN step < 0 THEN -step ELSE 0 END AS dn FROM q0),
q2 AS (SELECT *, {o.roll('stddev_samp', 'lr', 20)} AS sv, CASE WHEN rn >= 20 THEN close / ma END AS sp, {o.roll('avg', 'up', 14)} AS ug, {o.roll('avg', 'dn', 14)} AS dg FROM q1),
q3 AS (SELECT *, CASE WHEN dg = 0 AND ug > 0 THEN 100 ELSE 100 - 100 / nullif(1 + ug / nullif(dg, 0), 0) END AS rs FROM q2),
seq AS MATERIALIZED (SELECT ticker, date, rn, close, {', '.join(f"coalesce(first_value({c} IGNORE NULLS) OVER fw, last_value({c} IGNORE NULLS) OVER bw) AS {n}" for c, n in (('ret', 'seq_returns'), ('sv', 'seq_volatility'), ('sp', 'seq_price_to_sma'), ('rs', 'seq_rsi')))}
  FROM q3 WINDOW fw AS (PARTITION BY ticker ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), bw AS (PARTITION BY ticker ORDER BY rn ROWS UNBOUNDED PRECEDING))"""


@query("sequence_inputs", sql(BARS, SEQ, select=f"SELECT ticker, date, {rs(' '.join(sequences.INPUTS))} FROM seq"))
def _(spark, sf):
    return pick(sequences.sequence_inputs(market(spark, sf).bars()), f"ticker date {' '.join(sequences.INPUTS)}")


_targets = ", ".join(f"{r(f'lead(seq_returns, {h}) OVER w', f'return_{h}d')}, CASE WHEN coalesce(lead(seq_returns, {h}) OVER w > 0, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS direction_{h}d" for h in (5, 10, 20))


@query("sequence_targets", sql(BARS, SEQ, select=f"SELECT ticker, date, {_targets} FROM seq WINDOW w AS (PARTITION BY ticker ORDER BY rn)"))
def _(spark, sf):
    df = sequences.return_targets(sequences.sequence_inputs(market(spark, sf).bars()))
    return pick(df, "ticker date return_5d direction_5d return_10d direction_10d return_20d direction_20d")


@query("sequence_windows", sql(BARS, SEQ, select=f"""SELECT ticker, date, CASE WHEN rn >= 60 THEN 240 ELSE 0 END AS n_values,
  round(CASE WHEN rn >= 60 THEN lag(seq_returns, 59) OVER w END + 3.7e-08, 6) + 0.0 AS oldest_return, round(CASE WHEN rn >= 60 THEN seq_rsi END + 3.7e-08, 6) + 0.0 AS newest_rsi FROM seq WINDOW w AS (PARTITION BY ticker ORDER BY rn)"""))
def _(spark, sf):
    df = sequences.with_sequences(sequences.sequence_inputs(market(spark, sf).bars()))
    s = F.col("sequence")
    return rounded(df.select("ticker", "date", F.when(s.isNotNull(), F.size(s)).otherwise(0).alias("n_values"), s[0].alias("oldest_return"), F.try_element_at(s, F.lit(-1)).alias("newest_rsi")))


# --- feature contract ----------------------------------------------------------------------------------------------------------------

_names = lambda names: ", ".join(f"'{c}'" for c in names)
_pair_columns = ("lstm_price_5d", "lstm_price_10d", "lstm_price_20d", *DROPPABLE)
_neutral = ", ".join(f"close AS {c}" for c in _pair_columns[:3])
# Neutral sequence columns hold the price or constants; constants have no correlation.
CONTRACT = (BARS, ROLL, STATES, f"""alls AS MATERIALIZED (SELECT r.*, s.* EXCLUDE (ticker, date, rn, close), ema_short AS kc_mid, rsi_14 AS rsi,
  atr / r.close AS atr_price_ratio, price_momentum_10d / (atr / r.close + 1e-8) AS risk_adjusted_momentum, {_neutral.replace('close', 'r.close')} FROM rolling r JOIN states s USING (ticker, rn)),
by_corr AS (SELECT DISTINCT a AS feature FROM (SELECT unnest([{", ".join(f"{{'a': '{a}', 'r': corr({chr(34)}{a}{chr(34)}, {chr(34)}{b}{chr(34)})}}" for i, a in enumerate(_pair_columns) for b in _pair_columns[i + 1:])}],
  recursive := true) FROM alls) WHERE abs(r) > 0.98),
weak AS (SELECT unnest([{_names(f for f in LOW_IMPORTANCE)}]) AS feature EXCEPT SELECT feature FROM by_corr),
seed AS (SELECT unnest([{_names(SEED_FEATURES)}]) AS feature, unnest(range(1, {len(SEED_FEATURES) + 1})) AS place),
final AS (SELECT feature, row_number() OVER (ORDER BY place) AS position FROM seed WHERE feature NOT IN (SELECT feature FROM by_corr) AND feature NOT IN (SELECT feature FROM weak))""")


@query("resolved_contract", sql(*CONTRACT, select="SELECT CAST(position AS INTEGER) AS position, feature FROM final"))
def _(spark, sf):
    return contract.contract_rows(market(spark, sf).contract(), spark).filter("part = 'final'").select("position", "feature")


@query("dropped_columns", sql(*CONTRACT, select="SELECT feature, 'correlated' AS reason FROM by_corr UNION ALL SELECT feature, 'low_importance' AS reason FROM weak"))
def _(spark, sf):
    rows = contract.contract_rows(market(spark, sf).contract(), spark)
    reason = F.when(F.col("part") == "removed_by_corr", "correlated").when(F.col("part") == "removed_by_importance", "low_importance")
    return rows.select("feature", reason.alias("reason")).filter("reason is not null")


# --- fitted models (checked by properties in the tests and by facts that SQL can state) -----------------------------------------------

# Columns of the feature table that the models need; the contract's other columns are learned inside the folds.
TRAINED = ("distance_to_ma200", "macd", "macds", "roc_20", "atr", "volatility_20", "ema_short", "ema_long", "price_to_sma20", "ADX_14", "mfi", "close_vix_ratio")
_of_states = ("macd", "macds", "atr", "ema_short", "ema_long", "ADX_14")
TRAINING = """
labelled AS MATERIALIZED (SELECT ticker, date, rn AS bar_rn, row_number() OVER (PARTITION BY ticker ORDER BY rn) AS rn, close, target,
  volatility_20, price_to_sma20, distance_to_ma200, rolling_volatility_zscore, count(*) OVER (PARTITION BY ticker) AS total
  FROM barriers JOIN (SELECT ticker, rn, """ + ", ".join(f'"{c}"' for c in _of_states) + """ FROM states) USING (ticker, rn)
  WHERE target IS NOT NULL AND """ + " AND ".join(f'"{c}" IS NOT NULL' for c in TRAINED) + ")"
TO_TRAINING = (*TO_LABELS, TRAINING, o.FOLDS)
USABLE = (*TO_TRAINING, f"checks AS ({REASON})", "used AS (SELECT m.* FROM members m SEMI JOIN (SELECT ticker, fold FROM checks WHERE reason IS NULL) USING (ticker, fold))")


@query("forecast_recommendations")
def _(spark, sf):
    run = forecast(market(spark, sf))
    return pick(run.recommendations, "ticker n_models avg_prob spread consensus state reason expected_value quality advice")


@query("forecast_fold_results")
def _(spark, sf):
    run = forecast(market(spark, sf))
    return pick(run.results, "ticker fold auc aucpr net_sharpe net_return fold_trades reason")


@query("forecast_fold_sizes", sql(*USABLE, select="SELECT ticker, fold, n_val, n_train FROM checks WHERE reason IS NULL"))
def _(spark, sf):
    return forecast(market(spark, sf)).results.select("ticker", "fold", "n_val", "n_train")


@query("forecast_fold_accounts", sql(*USABLE, select="SELECT ticker, count(*) AS n_folds_configured FROM checks GROUP BY ticker"))
def _(spark, sf):
    return forecast(market(spark, sf)).runs.select("ticker", "n_folds_configured")


@query("forecast_run_metrics")
def _(spark, sf):
    run = forecast(market(spark, sf))
    return pick(run.runs, "ticker n_folds_valid n_folds_skipped coverage_ratio auc net_sharpe win_rate calibration_enabled calibration_method calibration_error brier")


@query("boosted_scores")
def _(spark, sf):
    return pick(forecast(market(spark, sf)).predictions, "ticker fold date target p_model p_raw")


@query("boosted_score_rows", sql(*USABLE, select="SELECT ticker, fold, date, target, true AS is_probability FROM used WHERE role = 'val'"))
def _(spark, sf):
    ok = F.col("p_model").between(0, 1) & F.col("p_raw").between(0, 1)
    return forecast(market(spark, sf)).predictions.select("ticker", "fold", "date", "target", ok.alias("is_probability"))


@query("forecast_calibration_plan", sql(*USABLE, """s AS (SELECT fold, count(*) FILTER (role = 'train') AS n FROM used GROUP BY fold),
k AS (SELECT u.*, row_number() OVER w AS k, count(*) OVER (PARTITION BY ticker, fold) AS m, CASE WHEN n >= 300 THEN 0.2 ELSE 0.15 END AS share FROM used u JOIN s USING (fold)
  WHERE role = 'train' AND n >= 180 WINDOW w AS (PARTITION BY ticker, fold ORDER BY rn)),
c AS (SELECT *, count(*) OVER g AS c, min(target) OVER g AS lo, max(target) OVER g AS hi FROM k WHERE m >= 100 AND k > floor(m * (1 - share)) WINDOW g AS (PARTITION BY ticker, fold)),
h AS (SELECT fold, count(*) AS n_held, count(DISTINCT target) AS classes FROM c WHERE c >= 30 AND lo < hi GROUP BY fold)""",
       select="SELECT fold, coalesce(n_held >= 60 AND classes = 2, false) AS calibrated FROM s LEFT JOIN h USING (fold)"))
def _(spark, sf):
    return forecast(market(spark, sf)).predictions.groupBy("fold").agg(F.bool_and(F.col("calibration_method") != "none").alias("calibrated"))


@query("regime_pair_scores")
def _(spark, sf):
    run = forecast(market(spark, sf), regime_split=True)
    return pick(run.predictions, "ticker fold date target p_raw")


@query("regime_sides", sql(*USABLE, "h AS (SELECT *, coalesce(rolling_volatility_zscore > 1.0, false) AS high FROM used)",
       "n AS (SELECT fold, least(count(*) FILTER (high AND role = 'train'), count(*) FILTER (NOT high AND role = 'train')) >= 126 AS split FROM h GROUP BY fold)",
       select="SELECT fold, CASE WHEN NOT split THEN 'all' WHEN high THEN 'high' ELSE 'low' END AS side, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'val') AS n_val FROM h JOIN n USING (fold) GROUP BY ALL"))
def _(spark, sf):
    data, _ = fold_rows(market(spark, sf))
    sides = models.with_sides(evaluation.high_volatility(data))
    return sides.groupBy("fold", "side").agg(F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "val").alias("n_val"))


@query("boosted_trees")
def _(spark, sf):
    # One row per tree: its place, the validation precision after it, whether the model keeps it, and its size.
    trees = forecast(market(spark, sf)).trees
    splits = F.size(F.filter("feature", lambda f: f >= 0))
    return rounded(trees.select("fold", "tree", "aucpr", "kept", splits.alias("n_splits")))


_BINS = 16
_gain = lambda g, h: f"((greatest(abs({g}) - 0.2, 0) ** 2) / ({h} + 1.0))"


@query("boosted_split_gains", sql(*TO_FOLDS, f"""e AS (SELECT fold, unnest(range(1, {_BINS})) AS b, unnest(quantile_disc(price_to_sma20, [{", ".join(f"{k}/{_BINS}" for k in range(1, _BINS))}])) AS cut FROM members WHERE role = 'train' GROUP BY fold),
p AS (SELECT fold, avg(target) AS p FROM members WHERE role = 'train' GROUP BY fold),
bins AS (SELECT m.fold, count(e.cut) AS bin, any_value(m.target) AS y FROM members m LEFT JOIN e ON e.fold = m.fold AND e.cut < m.price_to_sma20 WHERE role = 'train' GROUP BY m.fold, m.ticker, m.rn),
sums AS (SELECT fold, bin, sum(round((p - y) * 1048576)) AS g, sum(round(p * (1 - p) * 1048576)) AS h FROM bins JOIN p USING (fold) GROUP BY fold, bin),
cum AS (SELECT fold, bin, sum(g) OVER u / 1048576 AS gl, sum(h) OVER u / 1048576 AS hl, sum(g) OVER w / 1048576 AS g, sum(h) OVER w / 1048576 AS h FROM sums
  WINDOW u AS (PARTITION BY fold ORDER BY bin ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY fold))""",
       select=f"SELECT fold, CAST(bin AS INTEGER) AS bin, round({_gain('gl', 'hl')} + {_gain('(g - gl)', '(h - hl)')} - {_gain('g', 'h')} + 3.7e-6, 4) + 0.0 AS gain FROM cum WHERE hl >= 2 AND h - hl >= 2"))
def _(spark, sf):
    # Gains of all splits of one feature at the root of every fold's first tree, on all rows.
    m, s = market(spark, sf), boosting.BoostSetting(depth=1, rows=1.0, columns=1.0, max_step=0.0, bins=_BINS)
    rows = m.members().select("ticker", "rn", "fold", "role", "target", "price_to_sma20", F.lit(1.0).alias("weight"))
    return rounded(boosting.root_gains(rows, ["price_to_sma20"], s).select("fold", "bin", "gain"), 4)


@query("feature_importance")
def _(spark, sf):
    # The report shows the model of the last fold.
    m = market(spark, sf)
    trees, names = forecast(m).trees, fold_rows(m)[1]
    last = trees.agg(F.max("fold").alias("fold"))
    return rounded(models.feature_importance(trees.join(last, "fold"), names))


@query("feature_importance_shares", sql(*USABLE, select="SELECT DISTINCT fold, 1.0::DOUBLE AS total, 25 AS n_features, true AS none_negative FROM used WHERE role = 'val'"))
def _(spark, sf):
    m = market(spark, sf)
    found = boosting.importance(forecast(m).trees, fold_rows(m)[1])
    return rounded(found.groupBy("fold").agg(
        F.sum("importance").alias("total"), F.count(F.lit(1)).cast("int").alias("n_features"), F.bool_and(F.col("importance") >= 0).alias("none_negative")))


@query("tuned_setting")
def _(spark, sf):
    # Settings are tuned on the first usable fold and reused for the others.
    m = market(spark, sf)
    data, names = fold_rows(m)
    first = data.agg(F.min("fold").alias("fold"))
    return rounded(models.tune(data.join(first, "fold"), names, models.tuning_candidates("low"), keeper(m))[1])


def _scored_members(spark, sf) -> DataFrame:
    m = market(spark, sf)
    return m.stages.table("scored_members", m.payload(), lambda: mk.score(folds.robust_scale(folds.usable(m.members()), mk.SCORED, "_scaled")), ["fold"])


_TO_CALIBRATION = (*TO_PREDS, """both_roles AS (SELECT *, round(1 / (1 + exp(-(0.6 * s2 - 1.0 * s1))), 6) AS p FROM scaled),
hk AS (SELECT *, row_number() OVER (PARTITION BY ticker, fold ORDER BY rn) AS k, count(*) OVER (PARTITION BY ticker, fold) AS n FROM both_roles WHERE role = 'train'),
held AS (SELECT *, count(*) OVER g AS m, min(target) OVER g AS lo, max(target) OVER g AS hi FROM hk WHERE n >= 100 AND k > floor(n * 0.8) WINDOW g AS (PARTITION BY ticker, fold)),
pts AS MATERIALIZED (SELECT fold, p, sum(target) AS y, count(*) AS n, row_number() OVER (PARTITION BY fold ORDER BY p) AS i FROM held WHERE m >= 30 AND lo < hi GROUP BY fold, p)""")
# The isotonic value at i: the largest, over starts up to i, of the smallest mean to any end from i on.
_ISOTONIC = """spans AS (SELECT a.fold, a.i AS i, b.i AS j, sum(b.y) OVER w / sum(b.n) OVER w AS mean FROM pts a JOIN pts b ON a.fold = b.fold AND b.i >= a.i
  WINDOW w AS (PARTITION BY a.fold, a.i ORDER BY b.i ROWS UNBOUNDED PRECEDING)),
ends AS (SELECT fold, i, j, min(mean) OVER (PARTITION BY fold, i ORDER BY j DESC ROWS UNBOUNDED PRECEDING) AS low FROM spans),
iso AS MATERIALIZED (SELECT e.fold, j AS i, max(low) AS v FROM ends e GROUP BY e.fold, j)"""


@query("isotonic_calibration", sql(*_TO_CALIBRATION, _ISOTONIC, select=f"SELECT fold, p AS p_raw, {r('least(greatest(v, 1e-6), 1 - 1e-6)', 'p_isotonic')} FROM iso JOIN pts USING (fold, i)"))
def _(spark, sf):
    held = calibration.calibration_rows(_scored_members(spark, sf).filter("role = 'train'"))
    counts = calibration.by_score(held, ["fold"])
    asked = counts.select("fold", F.col("p").alias("p_raw"))
    return pick(calibration.apply_isotonic(asked, calibration.isotonic(counts, ["fold"]), ["fold"]), "fold p_raw p_isotonic")


def _newton(k: int) -> str:
    return f"""n{k + 1} AS MATERIALIZED (SELECT fold, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM (
  SELECT fold, any_value(a) AS a, any_value(b) AS b, sum((n * q - y) * p) + any_value(a) AS ga, sum(n * q - y) AS gb,
    sum(n * q * (1 - q) * p * p) + 1 AS haa, sum(n * q * (1 - q) * p) AS hab, sum(n * q * (1 - q)) AS hbb
  FROM (SELECT *, 1 / (1 + exp(-(a * p + b))) AS q FROM pts JOIN n{k} USING (fold)) GROUP BY fold))"""


_SIGMOID = "n0 AS (SELECT DISTINCT fold, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM pts)," + ",".join(map(_newton, range(10)))


@query("sigmoid_calibration", sql(*_TO_CALIBRATION, _SIGMOID, select=f"SELECT fold, {r('a', 'slope')}, {r('b', 'offset')} FROM n10"))
def _(spark, sf):
    held = calibration.calibration_rows(_scored_members(spark, sf).filter("role = 'train'"))
    m = market(spark, sf)
    counts = keeper(m)(calibration.by_score(held, ["fold"]), "score-counts")
    return pick(calibration.sigmoid(counts, ["fold"]), "fold slope offset")


_EDGES = [float(e) for e in np.linspace(0.0, 1.0, 11)[1:-1]]
_ECE = lambda p: f"""(SELECT fold, sum(gap * n) / sum(n) AS ece, sum(sq) / sum(n) AS brier FROM (SELECT fold, {" + ".join(f"CAST({p} >= {e!r}::DOUBLE AS INTEGER)" for e in _EDGES)} AS bin, count(*) AS n, abs(avg(target) - avg({p})) AS gap, sum(({p} - target) ** 2) AS sq FROM cal GROUP BY fold, bin) GROUP BY fold)"""


@query("calibration_choice", sql(*_TO_CALIBRATION, _ISOTONIC, _SIGMOID, """pt AS MATERIALIZED (SELECT fold, p, v, i FROM iso JOIN pts USING (fold, i)),
asked AS (SELECT DISTINCT fold, p_raw AS x FROM preds),
near AS (SELECT fold, x, arg_max(pt.p, pt.i) FILTER (pt.p <= x) AS pa, arg_max(v, pt.i) FILTER (pt.p <= x) AS va, arg_min(pt.p, pt.i) FILTER (pt.p >= x) AS pb, arg_min(v, pt.i) FILTER (pt.p >= x) AS vb
  FROM asked JOIN pt USING (fold) GROUP BY fold, x),
line AS (SELECT fold, x, CASE WHEN pa IS NULL THEN vb WHEN pb IS NULL OR pa = pb THEN va ELSE va + (vb - va) * (x - pa) / (pb - pa) END AS v FROM near),
cal AS MATERIALIZED (SELECT p.fold, target, least(greatest(v, 1e-6), 1 - 1e-6) AS ci, least(greatest(1 / (1 + exp(-(a * p_raw + b))), 1e-6), 1 - 1e-6) AS cs
  FROM preds p JOIN line l ON l.fold = p.fold AND l.x = p.p_raw JOIN n10 ON n10.fold = p.fold)""",
       f"scored AS (SELECT i.fold, i.ece > 0.05 AND s.ece < i.ece AS switch, i.ece > 0.05 AS alarm, i.ece AS ie, i.brier AS ib, s.ece AS se, s.brier AS sb FROM {_ECE('ci')} i JOIN {_ECE('cs')} s USING (fold))",
       select=f"""SELECT fold, true AS calibration_enabled, CASE WHEN switch THEN 'sigmoid' ELSE 'isotonic' END AS calibration_method,
  CASE WHEN switch THEN 'fallback_from_isotonic_ece' WHEN alarm THEN 'ok|sigmoid_not_better' ELSE 'ok' END AS calibration_reason,
  {r('CASE WHEN switch THEN se ELSE ie END', 'calibration_error')}, {r('CASE WHEN switch THEN sb ELSE ib END', 'brier')} FROM scored"""))
def _(spark, sf):
    # An alarm that some folds do raise, so that all three outcomes occur.
    m, rows = market(spark, sf), _scored_members(spark, sf)
    val = rows.filter("role = 'val'").withColumn("p_model", F.col("p_raw")).drop("p_raw")
    held = calibration.calibration_rows(rows.filter("role = 'train'")).withColumn("p_model", F.col("p_raw"))
    found = calibration.calibrated(val, held, calibration.planned(rows), keeper(m), alert=0.05)
    return rounded(calibration.quality(found, ["fold"]))


@query("calibration_rows", sql(*TO_FOLDS, """k AS (SELECT *, row_number() OVER (PARTITION BY ticker, fold ORDER BY rn) AS k, count(*) OVER (PARTITION BY ticker, fold) AS n FROM members WHERE role = 'train'),
c AS (SELECT *, count(*) OVER g AS m, min(target) OVER g AS lo, max(target) OVER g AS hi FROM k WHERE n >= 100 AND k > floor(n * (1 - 0.2)) WINDOW g AS (PARTITION BY ticker, fold))""",
       select="SELECT ticker, fold, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM c WHERE m >= 30 AND lo < hi GROUP BY ticker, fold"))
def _(spark, sf):
    rows = calibration.calibration_rows(market(spark, sf).members().filter("role = 'train'"))
    return rows.groupBy("ticker", "fold").agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("synthetic_minority")
def _(spark, sf):
    data, names = fold_rows(market(spark, sf))
    made = models.synthetic_minority(data.filter("role = 'train'"), names)
    return made.groupBy("ticker", "fold", "target", "synthetic").agg(F.count(F.lit(1)).alias("n_rows"))


@query("synthetic_rows_between_parents", sql(*USABLE, "c AS (SELECT ticker, fold, target, count(*) AS n FROM used WHERE role = 'train' GROUP BY ALL)",
       select="SELECT ticker, fold, target, n AS n_real, true AS only_smaller, true AS inside FROM c"))
def _(spark, sf):
    # Every made row lies between two rows of its class, so inside the range of the class in each feature.
    data, names = fold_rows(market(spark, sf))
    made = models.synthetic_minority(data.filter("role = 'train'"), names)
    side = lambda f, c, flag: f(F.when(F.col("synthetic") == flag, F.col(c)))
    inside = [F.coalesce((side(F.min, c, True) >= side(F.min, c, False) - 1e-9) & (side(F.max, c, True) <= side(F.max, c, False) + 1e-9), F.lit(True)) for c in names]
    per_class = made.groupBy("ticker", "fold", "target").agg(
        F.count_if(~F.col("synthetic")).alias("n_real"), F.count_if("synthetic").alias("_made"), reduce(lambda a, b: a & b, inside).alias("inside"))
    larger = F.max("n_real").over(Window.partitionBy("ticker", "fold"))
    return per_class.withColumn("only_smaller", (F.col("_made") == 0) | (F.col("n_real") < larger)).drop("_made")


# Requested columns that the feature table has; the sequence columns belong to folds.
TECHNICAL = tuple(f for f in SEED_FEATURES if not f.startswith("lstm_"))


@query("eliminated_features")
def _(spark, sf):
    rows = market(spark, sf).labelled(TECHNICAL)
    kept = models.eliminate_features(rows, TECHNICAL)
    return rounded(rows.groupBy("ticker").agg(*[F.avg(c).alias(f"kept_{i}_mean") for i, c in enumerate(kept)], F.lit(",".join(kept)).alias("kept")))


@query("sequence_encoding")
def _(spark, sf):
    # What each usable fold learns from its own training rows.
    data, _ = fold_rows(market(spark, sf))
    return pick(data, "ticker fold date role lstm_dir_5d lstm_dir_20d lstm_return_confidence lstm_latent_0 lstm_latent_9")


@query("sequence_encoding_facts", sql(*USABLE, select="""SELECT ticker, fold, count(*) AS n_rows, count(*) FILTER (role = 'train') AS n_train, true AS centred, true AS probabilities,
  true AS filled FROM used GROUP BY ticker, fold"""))
def _(spark, sf):
    # Latents are centred on the windows whose targets lie inside the training rows; the rows before the first window repeat it.
    data, _ = fold_rows(market(spark, sf))
    place = F.row_number().over(Window.partitionBy("ticker", "fold").orderBy("rn"))
    n_train = F.count_if(F.col("role") == "train").over(Window.partitionBy("ticker", "fold"))
    rows = data.withColumns({"_k": place, "_n": n_train})
    learned = F.col("_k").between(F.lit(sequences.WINDOW_ROWS), F.col("_n") - max(sequences.HORIZONS))
    first = F.first("lstm_latent_0").over(Window.partitionBy("ticker", "fold").orderBy("rn"))
    rows = rows.withColumn("_same", (F.col("_k") > sequences.WINDOW_ROWS) | (F.col("lstm_latent_0") == first))
    near = [F.abs(F.avg(F.when(learned, F.col(f"lstm_latent_{i}")))) < 1e-6 for i in (0, 1, 3, 9)]
    return rows.groupBy("ticker", "fold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("role") == "train").alias("n_train"), reduce(lambda a, b: a & b, near).alias("centred"),
        F.bool_and(F.col("lstm_dir_5d").between(0, 1) & F.col("lstm_dir_20d").between(0, 1)).alias("probabilities"), F.bool_and("_same").alias("filled"))
