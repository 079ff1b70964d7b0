import numpy as np
import pandas as pd
from conftest import by_row, same

from tickloom.functions.series import Layout
from tickloom.operators import indicators, labels

SMALL = Layout(64)


def test_volatility_barriers_equal_a_row_loop(bars, bars_pdf):
    out = by_row(labels.volatility_barriers(indicators.rolling_volatility(bars, SMALL), SMALL), "target", "barrier_up", "barrier_down")
    for t, g in bars_pdf.groupby("ticker"):
        got = out[out.ticker == t].reset_index(drop=True)
        vol = g.close.rolling(20).std().ffill().bfill().to_numpy()
        c, h, lo = (g[k].to_numpy() for k in ("close", "high", "low"))
        want = np.full(len(c), np.nan)
        for i in range(len(c) - 20):
            ups = np.flatnonzero(h[i + 1:i + 21] >= c[i] + 2.0 * vol[i])
            downs = np.flatnonzero(lo[i + 1:i + 21] <= c[i] - 1.5 * vol[i])
            if len(ups) or len(downs):
                first_up, first_down = (x[0] if len(x) else 99 for x in (ups, downs))
                want[i] = 1.0 if first_up < first_down else 0.0
        same(got["target"], want)
        assert ((got.barrier_down < g.close.to_numpy()) & (g.close.to_numpy() < got.barrier_up)).all()


def test_percent_barriers_equal_a_row_loop(bars, bars_pdf):
    plain = by_row(labels.percent_barriers(bars, SMALL), "label")
    any_ = by_row(labels.percent_barriers_any(bars, SMALL), "label")
    for t, g in bars_pdf.groupby("ticker"):
        c, d = g.close.to_numpy(), pd.to_datetime(g.date).to_numpy()
        first, free = [], []
        for i in range(len(c)):
            limit = d[i] + np.timedelta64(10, "D")
            value = 0
            for j in range(i + 1, len(c)):
                if d[j] > limit:
                    value = int(np.sign(c[j] - c[i]))
                elif c[j] >= c[i] * 1.01:
                    value = 1
                elif c[j] <= c[i] * 0.995:
                    value = -1
                else:
                    continue
                break
            first.append(value)
            ahead, days = c[i + 1:i + 50], d[i + 1:i + 50]
            if not len(ahead):
                free.append(0)
            elif (ahead >= c[i] * 1.01).any():
                free.append(1)
            elif (ahead <= c[i] * 0.995).any():
                free.append(-1)
            else:
                late = np.flatnonzero(days > limit)
                free.append(int(np.sign((ahead[late[0]] if len(late) else ahead[-1]) - c[i])))
        same(plain[plain.ticker == t]["label"], first)
        same(any_[any_.ticker == t]["label"], free)


def test_the_two_percent_labellings_differ(bars):
    a, b = labels.percent_barriers(bars, SMALL), labels.percent_barriers_any(bars, SMALL)
    assert (by_row(a, "label")["label"] != by_row(b, "label")["label"]).any()


def test_shares_add_up_to_one(bars):
    df = labels.label_distribution(labels.named_labels(labels.volatility_barriers(indicators.rolling_volatility(bars, SMALL), SMALL)), "label")
    total = df.groupBy("ticker").sum("share", "n_rows").collect()
    assert all(abs(r["sum(share)"] - 1) < 1e-12 and r["sum(n_rows)"] == 700 for r in total)
