"""Bar tables: reading, building from trade rows, joining the index."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.series import KEY, TIME, Layout, fill, number_rows
from tickloom.settings import LOOKBACK_DAYS

BAR_SCHEMA = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("date", T.DateType()),
    *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")),
])


def snake_case(df: DataFrame) -> DataFrame:
    """Lower-case column names, spaces to underscores."""
    return df.withColumnsRenamed({c: c.lower().replace(" ", "_") for c in df.columns})


def between_dates(df: DataFrame, start: date | str | None = None, end: date | str | None = None) -> DataFrame:
    """Rows of a date range; both ends reach the scan as pushed filters."""
    if start is not None:
        df = df.filter(F.col(TIME) >= F.lit(start).cast("date"))
    return df.filter(F.col(TIME) <= (F.lit(end).cast("date") if end is not None else F.current_date()))


def lookback(df: DataFrame, as_of: date | str, days: int = LOOKBACK_DAYS) -> DataFrame:
    """The last ``days`` days up to ``as_of``."""
    return between_dates(df.filter(F.col(TIME) >= F.date_sub(F.lit(as_of).cast("date"), days)), end=as_of)


def read_bars(
    spark: SparkSession, path: str, fmt: str = "parquet", start: date | str | None = None,
    end: date | str | None = None, tickers: list[str] | None = None,
) -> DataFrame:
    """Bars of a stored table (parquet, csv, json, orc); column names are normalised."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    df = snake_case(reader.format(fmt).load(path))
    df = df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in BAR_SCHEMA if f.name in df.columns])
    if tickers:
        df = df.filter(F.col(KEY).isin([t.strip().upper() for t in tickers]))
    return between_dates(df, start, end)


def bars_from_trades(
    trades: DataFrame, ticker: Column, day: Column, price: Column, volume: Column, order: Column
) -> DataFrame:
    """Daily bars of trade rows.

    Aggregates are combined on the map side, so a ticker or a day with most of
    the rows still sends one partial row per input partition into the shuffle.  ``order`` says
    which trade of a day is first; give it as one number (see ``packed``), since only values of
    fixed width are combined by hash, without a sort of all trades.
    """
    return (
        trades.select(ticker.alias(KEY), day.alias(TIME), price.alias("price"), volume.alias("volume"), order.alias("moment"))
        .groupBy(KEY, TIME)
        .agg(
            F.min_by("price", "moment").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "moment").alias("close"),
            F.sum("volume").alias("volume"),
        )
    )


def packed(digits: dict[str, int]) -> Column:
    """One number that is ordered as the whole, non-negative columns are, in the order given.

    Each column takes its stated count of decimal digits, 38 in all; a larger value is an error.
    """
    if sum(digits.values()) > 38:
        raise ValueError("a packed number has at most 38 digits")
    parts = [
        F.lpad(F.when(F.length(F.col(c).cast("string")) <= n, F.col(c).cast("string")).otherwise(F.raise_error(F.lit(f"{c} has more than {n} digits"))), n, "0")
        for c, n in digits.items()
    ]
    return F.concat(*parts).cast("decimal(38,0)")


def daily_index(rows: DataFrame, day: Column, value: Column, name: str = "vix_close") -> DataFrame:
    return rows.groupBy(day.alias(TIME)).agg(value.alias(name))


def with_index(bars: DataFrame, index: DataFrame) -> DataFrame:
    """Every bar, with the index of its day where there is one.

    Both sides are keyed by day; no hint is given, so the index is broadcast
    only when its measured size allows it.
    """
    return bars.join(index, TIME, "left")


def with_filled_index(bars: DataFrame, layout: Layout = Layout(), name: str = "vix_filled") -> DataFrame:
    """``vix_close`` carried forward over days without an index value (numbered bars)."""
    return fill(bars.withColumn(name, F.col("vix_close")), [name], layout)


def numbered(bars: DataFrame) -> DataFrame:
    """Row number per ticker and the carried-forward index, worked out year by year so that no
    task sees a whole ticker; a (ticker, year) has at most 366 days."""
    filled = {"vix_filled": "vix_close"} if "vix_close" in bars.columns else {}
    return number_rows(bars, F.year(TIME), filled=filled)
