"""Features from sliding windows of recent rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.series import KEY, ROW, Layout, div, fill, pct_change, roll, trailing

# Rows per window, return horizons, width of the compressed state.
WINDOW_ROWS, HORIZONS, LATENTS = 60, (5, 10, 20), 10
MIN_SEQUENCES_FOLD = 120
INPUTS = ("seq_returns", "seq_volatility", "seq_price_to_sma", "seq_rsi")


def simple_rsi(gain: Column, loss: Column, n: int, w) -> Column:
    """Relative strength from plain means; 100 when there was no loss."""
    up, down = roll(F.avg, gain, n, w), roll(F.avg, loss, n, w)
    return F.when((down == 0) & (up > 0), 100.0).otherwise(100 - div(F.lit(100.0), 1 + div(up, down)))


def sequence_inputs(bars: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Return, deviation of log returns, price against its mean and strength; gaps take the
    next, then the last known value."""
    w = Layout.window()
    close = F.col("close")
    step = close - F.lag("close").over(w)
    df = layout.spread(bars.select(KEY, "date", ROW, "close"), before=40).withColumns({
        "seq_returns": pct_change(close, w),
        "_log": F.ln(div(close, F.lag("close").over(w))),
        "_gain": F.when(step > 0, step).otherwise(0.0),
        "_loss": F.when(step < 0, -step).otherwise(0.0),
    }).withColumns({
        "seq_volatility": roll(F.stddev_samp, F.col("_log"), 20, w),
        "seq_price_to_sma": div(close, roll(F.avg, close, 20, w)),
        "seq_rsi": simple_rsi(F.col("_gain"), F.col("_loss"), 14, w),
    })
    out = Layout.core(df.drop("_log", "_gain", "_loss"))
    return fill(out, INPUTS, layout, ("next", "prev"))


def return_targets(df: DataFrame, layout: Layout = Layout(), horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """The one-day return ``h`` rows ahead and whether it is positive (missing counts as not)."""
    w = Layout.window()
    ahead = {h: F.lead("seq_returns", h).over(w) for h in horizons}
    return Layout.core(layout.spread(df, after=max(horizons)).withColumns({
        **{f"return_{h}d": c for h, c in ahead.items()},
        **{f"direction_{h}d": F.coalesce(c > 0, F.lit(False)).cast("double") for h, c in ahead.items()},
    }))


def with_sequences(df: DataFrame, cols: Sequence[str] = INPUTS, layout: Layout = Layout(), n: int = WINDOW_ROWS) -> DataFrame:
    """``sequence``: the last ``n`` rows of ``cols``, oldest first, as one array; null before that."""
    w = Layout.window()
    window = F.collect_list(F.array(*cols)).over(trailing(w, n))
    df = layout.spread(df, before=n).withColumn("_rows", window)
    return Layout.core(df.withColumn("sequence", F.when(F.size("_rows") == n, F.flatten("_rows"))).drop("_rows"))


def causal_means(inputs: DataFrame, spans: Sequence[int] = (2, 4, 8, 16), column: str = "seq_returns", name: str = "causal_return", layout: Layout = Layout()) -> DataFrame:
    """``name``: the mean of the means of ``column`` over the latest 2, 4, 8 and 16 rows, fewer at the start."""
    w = Layout.window()
    means = [F.avg(column).over(w.rowsBetween(1 - n, 0)) for n in spans]
    return Layout.core(layout.spread(inputs, before=max(spans)).withColumn(name, sum(means[1:], means[0]) / len(spans)))


def _target_columns(prefix: str, latent_dim: int = LATENTS) -> list[str]:
    return [f"{prefix}_{kind}_{h}d" for h in HORIZONS for kind in ("return", "price", "dir")] + [
        f"{prefix}_return_confidence", *(f"{prefix}_latent_{i}" for i in range(latent_dim))
    ]


def _default(name: str) -> Column:
    if "_price_" in name:
        return F.col("close")
    return F.lit(0.5 if "_dir_" in name else 0.0)


def placeholder_columns(df: DataFrame, prefixes: Sequence[str] = ("lstm",), latent_dim: int = LATENTS) -> DataFrame:
    """Neutral sequence columns that keep the schema when no encoder runs."""
    return df.withColumns({c: _default(c) for p in prefixes for c in _target_columns(p, latent_dim)})


def adapt_columns(df: DataFrame, latent_dim: int = LATENTS, source: str = "tcn", target: str = "lstm") -> DataFrame:
    """Copy the columns of one encoder under the names of the other; missing ones are neutral."""
    out = {}
    for name in _target_columns(target, latent_dim):
        own = source + name[len(target):]
        out[name] = F.col(own) if own in df.columns else _default(name)
    return df.withColumns(out)


def overwrite_columns(rows: DataFrame, fresh: DataFrame, cols: Sequence[str], keys: Sequence[str] = (KEY, "fold", "date")) -> DataFrame:
    """Replace ``cols`` by the values of ``fresh`` for the same keys; other rows keep theirs."""
    new = fresh.select(*keys, *[F.col(c).alias(f"_{c}") for c in cols])
    return rows.join(new, list(keys), "left").withColumns(
        {c: F.coalesce(f"_{c}", c) for c in cols}
    ).drop(*[f"_{c}" for c in cols])


def sequence_columns(prefix: str = "lstm", latent_dim: int = LATENTS) -> list[str]:
    """The columns that an encoder makes."""
    return _target_columns(prefix, latent_dim)


def _windows(x: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` rows at every row from the n-th on, oldest first, flattened."""
    return np.lib.stride_tricks.sliding_window_view(x, n, axis=0).transpose(0, 2, 1).reshape(max(0, len(x) - n + 1), -1)


def _ridge(z: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """Offset and slopes of least squares with an L2 penalty on the slopes."""
    a = np.column_stack([np.ones(len(z)), z])
    ridge = penalty * len(z) * np.diag([0.0] + [1.0] * z.shape[1])
    return np.linalg.solve(a.T @ a + ridge, a.T @ y)


def _logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 12) -> np.ndarray:
    a, w = np.column_stack([np.ones(len(z)), z]), np.zeros(z.shape[1] + 1)
    ridge = penalty * len(z) * np.diag([1e-6] + [1.0] * z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w - np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + ridge, a.T @ (p - y) + ridge @ w)
    return w


def encode_rows(
    x: np.ndarray, close: np.ndarray, train: np.ndarray, n: int = WINDOW_ROWS, latent_dim: int = LATENTS, least: int = MIN_SEQUENCES_FOLD,
    penalty: float = 1e-3,
) -> dict[str, np.ndarray] | None:
    """Latents, returns and directions of one fold's rows in order; None with too few sequences to learn from.

    ``x`` holds the sequence inputs, returns first.  Inputs are scaled by the training rows, latents are the
    principal components of their windows about the training mean, and a training target lies inside the
    training rows.  Rows before the first window take its values.
    """
    learn = np.flatnonzero(train)
    if len(learn) == 0:
        return None
    mean, width = x[learn].mean(axis=0), x[learn].std(axis=0)
    windows = _windows((x - mean) / np.where(width == 0, 1.0, width), n)
    at = np.arange(n - 1, len(x))
    last = learn[-1]
    usable = train[at] & (at + max(HORIZONS) <= last)
    if usable.sum() < least:
        return None
    centre = windows[usable].mean(axis=0)
    _, _, axes = np.linalg.svd(windows[usable] - centre, full_matrices=False)
    axes = axes[:latent_dim]
    # The sign of a component is free: its largest loading is made positive.
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    z = (windows - centre) @ axes.T
    full = np.column_stack([np.ones(len(z)), z])
    out, made = {}, {}
    for h in HORIZONS:
        known = train[at] & (at + h <= last)
        ahead = x[np.minimum(at + h, len(x) - 1), 0]
        out[f"return_{h}d"] = full @ _ridge(z[known], ahead[known], penalty)
        out[f"dir_{h}d"] = 1 / (1 + np.exp(-np.clip(full @ _logistic(z[known], (ahead[known] > 0).astype(float), penalty), -30, 30)))
    out["return_confidence"] = sum(np.abs(out[f"return_{h}d"]) for h in HORIZONS) / len(HORIZONS)
    for i in range(latent_dim):
        out[f"latent_{i}"] = z[:, i] if i < z.shape[1] else np.zeros(len(z))
    for name, values in out.items():
        made[name] = np.concatenate([np.full(n - 1, values[0]), values])
    for h in HORIZONS:
        made[f"price_{h}d"] = close * (1 + made[f"return_{h}d"])
    return made


def encode_folds(members: DataFrame, inputs: DataFrame, prefix: str = "lstm", latent_dim: int = LATENTS) -> DataFrame:
    """(ticker, fold, rn, sequence columns) of every fold row, learned from the fold's own training rows.

    ``members`` are fold rows with ``bar_rn`` and ``close``; ``inputs`` the sequence inputs by bar.  Each ticker's
    fold is one group (a sliding fold has at most ``train_rows + val_rows`` rows), and all groups run side by
    side; a fold with too few sequences gets the neutral columns.
    """
    names = _target_columns(prefix, latent_dim)
    schema = f"{KEY} string, fold int, {ROW} long, {', '.join(f'{c} double' for c in names)}"
    rows = members.select(KEY, "fold", ROW, "role", "close", "bar_rn").join(inputs.select(KEY, F.col(ROW).alias("bar_rn"), *INPUTS), [KEY, "bar_rn"])

    def encode(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(ROW)
        close = frame["close"].to_numpy(float)
        made = encode_rows(frame[list(INPUTS)].to_numpy(float), close, (frame["role"] == "train").to_numpy(), latent_dim=latent_dim)
        out = frame[[KEY, "fold", ROW]].reset_index(drop=True)
        neutral = {c: close if "_price_" in c else np.full(len(out), 0.5 if "_dir_" in c else 0.0) for c in names}
        values = neutral if made is None else {c: made[c[len(prefix) + 1:]] for c in names}
        return out.assign(**values)[[KEY, "fold", ROW, *names]]

    # An encoding costs far more than its bytes suggest, so the number of partitions is stated.
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, KEY, "fold").groupBy(KEY, "fold").applyInPandas(encode, schema)
