import numpy as np
import pandas as pd
import pytest
from conftest import by_row, same
from pyspark.sql import functions as F

from tickloom.functions.series import Layout
from tickloom.operators import indicators as ind
from tickloom.operators import sequences as seq

SMALL = Layout(300)


@pytest.fixture(scope="module")
def rolled(bars):
    return by_row(ind.rolling_features(bars, SMALL), *[c for c in ind.rolling_features(bars, SMALL).columns if c not in ("ticker", "rn", "date")])


def per_ticker(pdf, fn):
    return pd.concat([fn(g.reset_index(drop=True)) for _, g in pdf.groupby("ticker")], ignore_index=True)


@pytest.mark.parametrize("name,fn", [
    ("volatility_20", lambda g: g.close.rolling(20).std()),
    ("sma_100", lambda g: g.close.rolling(100).mean()),
    ("ma_200", lambda g: g.close.rolling(200).mean()),
    ("price_to_sma50", lambda g: g.close / g.close.rolling(50).mean()),
    ("high_52w", lambda g: g.high.rolling(252).max()),
    ("low_52w", lambda g: g.low.rolling(252).min()),
    ("roc_20", lambda g: 100 * (g.close / g.close.shift(20) - 1)),
    ("vix_change", lambda g: g.vix_close.ffill().pct_change()),
    ("bb_upper", lambda g: g.close.rolling(20).mean() + 2 * g.close.rolling(20).std(ddof=0)),
    ("rolling_volatility_zscore", lambda g: (lambda v: (v - v.rolling(252).mean()) / (v.rolling(252).std() + 1e-8))(g.close.rolling(20).std())),
    ("close_vix_ratio", lambda g: g.close / g.vix_close),
])
def test_rolling_features_equal_pandas(rolled, bars_pdf, name, fn):
    same(rolled[name], per_ticker(bars_pdf, fn), 1e-8)


def test_regime_compares_missing_values_as_false(rolled):
    first = rolled[rolled.rn == 1]
    assert (first.regime_state == -1).all() and (first.regime_change == 1).all()


def test_fractional_difference_needs_eleven_rows_and_weights_the_oldest_first(bars, bars_pdf):
    out = by_row(ind.market_structure_features(bars, SMALL), "fd_price_5", "vol_regime")
    weights = ind.fractional_weights(0.5)
    assert abs(weights[1] + 0.5) < 1e-12

    def fn(g):
        x = np.log(g.close.to_numpy())
        return pd.Series([np.nan if i < 10 else float(np.dot(weights, x[i - 9:i + 1])) for i in range(len(x))])

    same(out["fd_price_5"], per_ticker(bars_pdf, fn))
    rank = per_ticker(bars_pdf, lambda g: g.close.rolling(20).std().rolling(60).apply(lambda v: pd.Series(v).rank(pct=True).iloc[-1]))
    same(out["vol_regime"], rank)


def recursive(bars, layout):
    return by_row(ind.recursive_features(bars, layout), "ema_short", "macd", "macds", "rsi_14", "atr", "ADX_14", "garch_volatility", "kc_upper")


def test_recurrences_equal_row_loops(bars, bars_pdf):
    out = recursive(bars, Layout())

    def ema(x, n, start=0):
        y, s = np.full(len(x), np.nan), None
        for i in range(len(x)):
            if i == start + n - 1:
                s = np.nanmean(x[start:i + 1])
            elif i >= start + n:
                s = s + (x[i] - s) * 2 / (n + 1)
            if s is not None:
                y[i] = s
        return y

    def wilder(x, n):
        return pd.Series(x).ewm(alpha=1 / n, min_periods=n).mean().to_numpy()

    for t, g in bars_pdf.groupby("ticker"):
        got = out[out.ticker == t]
        c, h, lo = (g[k].to_numpy() for k in ("close", "high", "low"))
        d = np.diff(c, prepend=np.nan)
        same(got["ema_short"], ema(c, 20))
        macd = ema(c, 12) - ema(c, 26)
        same(got["macd"], macd, 1e-8)
        same(got["macds"], ema(macd, 9, 25), 1e-8)
        up, down = wilder(np.where(np.isnan(d), np.nan, np.maximum(d, 0)), 14), wilder(np.where(np.isnan(d), np.nan, np.maximum(-d, 0)), 14)
        same(got["rsi_14"], 100 * up / (up + down))
        pc = np.roll(c, 1)
        tr = np.maximum.reduce([h - lo, abs(h - pc), abs(pc - lo)])
        tr[0] = np.nan
        atr = wilder(tr, 14)
        same(got["atr"], atr)
        u, dn = np.diff(h, prepend=np.nan), -np.diff(lo, prepend=np.nan)
        plus = np.where(np.isnan(u), np.nan, np.where((u > dn) & (u > 0), u, 0))
        minus = np.where(np.isnan(u), np.nan, np.where((dn > u) & (dn > 0), dn, 0))
        p, m = 100 * wilder(plus, 14) / atr, 100 * wilder(minus, 14) / atr
        same(got["ADX_14"], wilder(100 * abs(p - m) / (p + m), 14), 1e-8)
        r = np.log(c[1:] / c[:-1])
        sigma, var = np.zeros(len(r)), 0.0
        sigma[:20] = r[:20].std()
        for i in range(20, len(r)):
            var = 0.1 * r[i - 1] ** 2 + 0.85 * var
            sigma[i] = np.sqrt(var)
        same(got["garch_volatility"], [np.nan, *sigma])


def test_chunked_recurrences_equal_whole_ones(spark):
    from conftest import make_bars

    pdf = make_bars(("LONG",), 2600)
    df = spark.createDataFrame(pdf.drop(columns="vix_close")).withColumn("rn", F.col("rn").cast("long"))
    whole = recursive(df, Layout(4096))
    for rows in (64, 1000):
        chunks = recursive(df, Layout(rows))
        for c in whole.columns[2:]:
            same(whole[c], chunks[c], 1e-9)


def test_ratios_of_states_survive_a_long_standstill(spark):
    from conftest import make_bars

    pdf = make_bars(("LONG",), 5000)
    for c in ("close", "high", "low"):
        pdf.loc[pdf.rn > 300, c] = pdf.loc[pdf.rn == 300, "close"].iloc[0]
    df = spark.createDataFrame(pdf.drop(columns="vix_close")).withColumn("rn", F.col("rn").cast("long"))
    d = pdf.close.diff()
    up, down = (x.ewm(alpha=1 / 14, min_periods=14).mean() for x in (d.clip(lower=0), (-d).clip(lower=0)))
    for rows in (256, 1200, 4096):
        got = recursive(df, Layout(rows))
        same(got["rsi_14"][300:], np.full(4700, (100 * up / (up + down)).iloc[299]), 1e-9)
        assert got["ADX_14"][300:].notna().all()


def test_interactions_exist_only_for_present_latents(bars):
    df = ind.engineer_features(seq.placeholder_columns(bars), Layout(), adx=False)
    assert "lstm3_×_macd" in df.columns and "lstm1_×_macd" not in df.columns
    assert df.select("ADX_14").distinct().collect()[0][0] == 20.0


def test_sequence_inputs_fill_back_then_forward(bars, bars_pdf):
    out = by_row(seq.sequence_inputs(bars, SMALL), *seq.INPUTS)
    assert out[list(seq.INPUTS)].notna().all().all()
    want = per_ticker(bars_pdf, lambda g: np.log(g.close / g.close.shift(1)).rolling(20).std().bfill().ffill())
    same(out["seq_volatility"], want)


def test_sequences_hold_the_last_rows_oldest_first(bars):
    inputs = seq.sequence_inputs(bars, SMALL)
    out = by_row(seq.with_sequences(inputs, ["close"], SMALL, 60), "close", "sequence")
    one = out[out.ticker == "AAA"].reset_index(drop=True)
    assert one["sequence"][58] is None
    same(one["sequence"][400], one["close"][341:401])


def test_targets_are_the_one_day_return_some_rows_ahead(bars):
    out = by_row(seq.return_targets(seq.sequence_inputs(bars, SMALL), SMALL), "seq_returns", "return_5d", "direction_5d")
    one = out[out.ticker == "AAA"].reset_index(drop=True)
    same(one["return_5d"][:695], one["seq_returns"][5:])
    assert (one["direction_5d"][695:] == 0).all()


def test_encoding_learns_from_training_rows_only():
    rng = np.random.default_rng(5)
    x, close, train = rng.normal(size=(360, 4)), 100 + rng.random(360), np.arange(360) < 280
    made = seq.encode_rows(x, close, train)
    learned = np.arange(seq.WINDOW_ROWS - 1, 280 - max(seq.HORIZONS))
    latents = np.stack([made[f"latent_{i}"] for i in range(seq.LATENTS)], axis=1)
    np.testing.assert_allclose(latents[learned].mean(axis=0), 0, atol=1e-9)
    # Principal components: uncorrelated, with the largest eigenvalues of the windows' covariance.
    z = (x - x[:280].mean(axis=0)) / x[:280].std(axis=0)
    windows = np.array([z[k - seq.WINDOW_ROWS + 1:k + 1].ravel() for k in learned])
    values = np.sort(np.linalg.eigvalsh(np.cov(windows.T)))[::-1][:seq.LATENTS]
    np.testing.assert_allclose(np.cov(latents[learned].T), np.diag(values), atol=1e-8)
    # What happens after the training rows changes nothing inside them.
    other = x.copy()
    other[280:] = 9.0
    again = seq.encode_rows(other, close, train)
    for name in made:
        np.testing.assert_allclose(made[name][:280], again[name][:280], atol=1e-12)
    assert all((made[name][:seq.WINDOW_ROWS] == made[name][seq.WINDOW_ROWS - 1]).all() for name in ("latent_0", "return_5d", "dir_20d"))
    np.testing.assert_allclose(made["price_10d"], close * (1 + made["return_10d"]))


def test_encoded_returns_are_ridge_regressions():
    rng = np.random.default_rng(6)
    z, y = rng.normal(size=(80, 3)), rng.normal(size=80)
    w = seq._ridge(z, y, 0.1)
    error = w[0] + z @ w[1:] - y
    assert abs(error.sum()) < 1e-9
    np.testing.assert_allclose(z.T @ error + 0.1 * 80 * w[1:], 0, atol=1e-9)
    t = (y > 0).astype(float)
    w = seq._logistic(z, t, 0.1)
    error = 1 / (1 + np.exp(-(w[0] + z @ w[1:]))) - t
    np.testing.assert_allclose(z.T @ error + 0.1 * 80 * w[1:], 0, atol=1e-6)


def test_folds_are_encoded_side_by_side_and_joined_back(bars):
    from tickloom.operators import folds
    from tickloom.settings import Settings

    rows = folds.labelled_rows(bars.withColumn("target", F.lit(1.0)), ["close"], SMALL)
    keys = ("ticker", "fold", "rn")
    for s, few in ((Settings(n_splits=2, train_rows=300, val_rows=60, min_val=20), False), (Settings(n_splits=2, train_rows=120, val_rows=60, min_val=20), True)):
        members = folds.fold_members(rows, s)
        out = seq.encode_folds(members, seq.sequence_inputs(bars, SMALL))
        assert out.columns == [*keys, *seq.sequence_columns()] and out.select(*keys).distinct().count() == members.count()
        assert out.filter("lstm_latent_0 is null or lstm_dir_5d not between 0 and 1").count() == 0
        # Too few windows give the neutral columns.
        assert (out.filter("lstm_latent_0 <> 0 or lstm_dir_5d <> 0.5").count() == 0) == few
        merged = seq.overwrite_columns(seq.placeholder_columns(members), out, ["lstm_latent_0", "lstm_return_5d"], keys)
        assert merged.count() == members.count() and (merged.filter("lstm_latent_0 <> 0").count() == 0) == few
    assert seq.encode_folds(members.limit(0), seq.sequence_inputs(bars, SMALL)).count() == 0

