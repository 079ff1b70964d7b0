import os
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def make_bars(tickers=("AAA", "BBB"), rows=700, seed=3) -> pd.DataFrame:
    """Random walks with gaps in the days and in the index."""
    rng = np.random.default_rng(seed)
    parts = []
    for t in tickers:
        days = pd.Timestamp("2015-01-01") + pd.to_timedelta(np.cumsum(rng.integers(1, 5, rows)), unit="D")
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, rows)))
        open_ = close * (1 + rng.normal(0, 0.005, rows))
        high = np.maximum(open_, close) * (1 + rng.random(rows) * 0.01)
        low = np.minimum(open_, close) * (1 - rng.random(rows) * 0.01)
        vix = np.where(rng.random(rows) < 0.2, np.nan, 20 + rng.normal(0, 2, rows))
        parts.append(pd.DataFrame({
            "ticker": t, "date": days.date, "open": open_, "high": high, "low": low, "close": close,
            "volume": rng.integers(100, 1000, rows).astype(float), "vix_close": vix, "rn": np.arange(1, rows + 1),
        }))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="session")
def bars_pdf():
    return make_bars()


@pytest.fixture(scope="session")
def bars(spark, bars_pdf):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(bars_pdf).withColumn("rn", F.col("rn").cast("long"))
    df = df.withColumn("vix_close", F.when(~F.isnan("vix_close"), F.col("vix_close")))
    from tickloom.functions.series import Layout
    from tickloom.sources.bars import with_filled_index

    return with_filled_index(df, Layout(128)).persist()


def by_row(df, *cols):
    return df.select("ticker", "rn", *cols).toPandas().sort_values(["ticker", "rn"]).reset_index(drop=True)


def same(a, b, tol=1e-9):
    a, b = np.asarray(a, float), np.asarray(b, float)
    assert np.array_equal(np.isnan(a), np.isnan(b)), np.where(np.isnan(a) != np.isnan(b))[0][:5]
    ok = ~np.isnan(a)
    np.testing.assert_allclose(a[ok], b[ok], rtol=tol, atol=tol)
