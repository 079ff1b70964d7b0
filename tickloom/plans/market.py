"""Bar panels derived from the sales tables, and the stage tables built on them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.series import KEY, Layout, div
from tickloom.operators import folds, indicators, labels, sequences
from tickloom.operators.contract import FeatureContract, contract_of, contract_rows, run_contract
from tickloom.sources.bars import bars_from_trades, daily_index, lookback, numbered, packed, with_index
from tickloom.settings import LOOKBACK_DAYS, Settings
from tickloom.sources.stages import Stages, code_key, files_key

# Features of the plain score below; the label stage keeps the rows that have them all.
KEPT = ("ticker", "date", "rn", "open", "high", "low", "close", "volume", "vix_close", "volatility_20", "atr", "rolling_volatility_zscore")
SCORED = ("price_to_sma20", "distance_to_ma200")
MODEL_FEATURES = ("volatility_20", *SCORED)
# Digits of the columns that order the line items of a day; the price is in cents.
ORDER = {"l_orderkey": 11, "l_linenumber": 1, "l_partkey": 10, "l_suppkey": 8, "cents": 8}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def trade_bars(spark: SparkSession, sf_dir: str, by_brand: bool = False) -> DataFrame:
    """Daily bars of the line items, per return flag and line status or per brand."""
    lines = load(spark, sf_dir, "lineitem")
    ticker = F.concat("l_returnflag", "l_linestatus")
    if by_brand:
        part = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
        lines = lines.join(part, lines.l_partkey == part.p_partkey)
        ticker = F.col("p_brand")
    price = 100 * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    lines = lines.withColumn("cents", F.round(100 * F.col("l_extendedprice")).cast("long"))
    return bars_from_trades(lines, ticker, F.to_date("l_shipdate"), price, F.col("l_quantity"), packed(ORDER))


def order_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    return daily_index(orders, F.to_date("o_orderdate"), F.avg("o_totalprice") / 10000)


def bars(spark: SparkSession, sf_dir: str, by_brand: bool = False) -> DataFrame:
    """Bars with the index of the day, straight from the tables."""
    return with_index(trade_bars(spark, sf_dir, by_brand), order_index(spark, sf_dir))


class Market:
    """The market, feature and label stages of one data folder.

    With ``as_of`` only the bars of the last ``days`` days up to it are read.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, by_brand: bool = False, layout: Layout = Layout(),
                 root: str | None = None, as_of: str | None = None, days: int = LOOKBACK_DAYS):
        self.spark, self.sf_dir, self.by_brand, self.layout = spark, sf_dir, by_brand, layout
        self.as_of, self.days = as_of, days
        self.stages = Stages(spark, root)
        names = ["lineitem", "orders"] + (["part"] if by_brand else [])
        self._inputs = files_key(spark, [os.path.join(sf_dir, f"{n}.parquet") for n in names])

    def payload(self, **more) -> dict:
        return {"code": code_key(), "inputs": self._inputs, "by_brand": self.by_brand,
                "chunk_rows": self.layout.chunk_rows, "as_of": self.as_of, "days": self.days, **more}

    def bars(self) -> DataFrame:
        """Numbered bars with the index and the carried-forward index."""
        def read() -> DataFrame:
            found = bars(self.spark, self.sf_dir, self.by_brand)
            return lookback(found, self.as_of, self.days) if self.as_of else found

        raw = self.stages.table("bars", self.payload(), read)
        return self.stages.table("market", self.payload(), lambda: numbered(raw))

    def features(self) -> DataFrame:
        return self.stages.table(
            "features", self.payload(), lambda: indicators.engineer_features(self.bars(), self.layout)
        )

    def labelled(self, features: tuple[str, ...] = MODEL_FEATURES) -> DataFrame:
        """Rows with features and a decided label, numbered anew, with the percent return of the row."""

        columns = [*KEPT, *[f for f in features if f not in KEPT]]

        def barriers() -> DataFrame:
            return labels.volatility_barriers(self.features().select(*columns), self.layout).select(*columns, "target")

        decided = self.stages.table("labels", self.payload(features=features), barriers)

        def number() -> DataFrame:
            rows = folds.labelled_rows(decided, features, self.layout)
            return rows.withColumn("bar_return", 100 * (div(F.col("close"), F.col("prev_close")) - 1))

        return self.stages.table("labelled", self.payload(features=features), number)

    def members(self, s: Settings = Settings(), scheme: str = "sliding", features: tuple[str, ...] = MODEL_FEATURES) -> DataFrame:
        return folds.fold_members(self.labelled(features), s, scheme)

    def contract(self) -> FeatureContract:
        """The columns that models train on, from the feature table and neutral sequence columns."""
        def resolve() -> DataFrame:
            found = sequences.placeholder_columns(self.features())
            made = sequences.sequence_columns()
            ordered = found.select(KEY, "date", *made, *[c for c in found.columns if c not in (KEY, "date", *made)])
            return contract_rows(run_contract(ordered), self.spark)

        return contract_of(self.stages.table("contract", self.payload(), resolve))

    def training_features(self) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """(columns of the feature table, sequence columns) of the contract."""
        made, final = set(sequences.sequence_columns()), self.contract().final
        return tuple(c for c in final if c not in made), tuple(c for c in final if c in made)

    def sequence_inputs(self) -> DataFrame:
        return self.stages.table("sequence_inputs", self.payload(), lambda: sequences.sequence_inputs(self.bars(), self.layout))

    def predictions(self) -> DataFrame:
        """Scored validation rows of every usable fold."""
        s = Settings()

        def build() -> DataFrame:
            members = folds.robust_scale(folds.usable(self.members(s), s), SCORED, "_scaled")
            return score(folds.validation_rows(members))

        return self.stages.table("predictions", self.payload(settings=repr(s)), build)


def score(rows: DataFrame, reversion: float = 1.0, trend: float = 0.6) -> DataFrame:
    """``p_raw``: logistic function of two scaled features, rounded so that every engine ranks it alike."""
    x = trend * F.col("distance_to_ma200_scaled") - reversion * F.col("price_to_sma20_scaled")
    return rows.withColumn("p_raw", F.round(1 / (1 + F.exp(-x)), 6))
