"""Which columns of a feature table a model may use (names only, decided on the driver)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tickloom.operators.profile import correlation_matrix
from tickloom.settings import KEPT_IN_CORRELATION_FILTER, LOW_IMPORTANCE, PROTECTED, SEED_FEATURES

# Endings of the sequence columns that exist for both encoders.
TWIN_SUFFIXES = (
    "price_5d", "price_10d", "price_20d", "return_5d", "return_10d", "return_20d", "dir_5d", "dir_10d", "dir_20d",
    "return_confidence",
)


@dataclass(frozen=True)
class FeatureContract:
    requested: tuple[str, ...]
    available: tuple[str, ...]
    removed_by_corr: tuple[str, ...]
    removed_by_importance: tuple[str, ...]
    missing_unexpected: tuple[str, ...]
    final: tuple[str, ...]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def drop_twins(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Drop a ``tcn_`` column when the ``lstm_`` column of the same meaning is there."""
    have = set(df.columns)
    dropped = [f"tcn_{s}" for s in TWIN_SUFFIXES if {f"tcn_{s}", f"lstm_{s}"} <= have]
    return df.drop(*dropped), dropped


def correlated_pairs(df: DataFrame, threshold: float = 0.98, protected: Sequence[str] = ()) -> DataFrame:
    """Pairs of droppable columns correlated beyond the threshold; ``a`` comes first in the table."""
    keep = {*PROTECTED, *KEPT_IN_CORRELATION_FILTER, *protected}
    cols = [c for c in numeric_columns(df) if c not in keep]
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    return correlation_matrix(df, cols).withColumn("r", F.abs("r")).filter(F.col("r") > threshold)


def drop_correlated(df: DataFrame, threshold: float = 0.98, protected: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Of each correlated pair the earlier column goes. Only pairs of names reach the driver."""
    order = {c: i for i, c in enumerate(df.columns)}
    pairs = correlated_pairs(df, threshold, protected).select("a").distinct().collect()
    dropped = sorted((p["a"] for p in pairs), key=order.__getitem__)
    return df.drop(*dropped), dropped


def drop_low_importance(
    df: DataFrame, known: Sequence[str] = (), persistent: Sequence[str] = ()
) -> tuple[DataFrame, list[str]]:
    """Drop the known weak features, those named by the caller and those weak in recent runs."""
    wanted = dict.fromkeys([*LOW_IMPORTANCE, *known, *persistent])
    dropped = [c for c in wanted if c in df.columns and c not in PROTECTED]
    return df.drop(*dropped), dropped


def resolve_contract(
    df: DataFrame, seed: Sequence[str] = SEED_FEATURES, removed_by_corr: Sequence[str] = (),
    removed_by_importance: Sequence[str] = (), min_features: int = 15,
) -> FeatureContract:
    have, numeric = set(df.columns), set(numeric_columns(df))
    available = tuple(f for f in seed if f in have)
    intended = {*removed_by_corr, *removed_by_importance}
    final = tuple(f for f in available if f in numeric)
    if len(final) < min_features:
        raise ValueError(f"feature contract too small: {len(final)} < {min_features}")
    return FeatureContract(
        tuple(seed), available, tuple(sorted(set(removed_by_corr))), tuple(sorted(set(removed_by_importance))),
        tuple(f for f in seed if f not in have and f not in intended), final,
    )


def run_contract(
    df: DataFrame, seed: Sequence[str] = SEED_FEATURES, threshold: float = 0.98, known: Sequence[str] = (), persistent: Sequence[str] = (),
    min_features: int = 15,
) -> FeatureContract:
    """The columns a model may use: twins, correlated and weak columns go, what is left of the request stays.

    A constant column has no correlation and goes for none.
    """
    left, _ = drop_twins(df)
    left, by_corr = drop_correlated(left, threshold)
    left, weak = drop_low_importance(left, known, persistent)
    return resolve_contract(left, seed, by_corr, weak, min_features)


def contract_rows(contract: FeatureContract, spark: SparkSession) -> DataFrame:
    """(part, position, feature): the name lists of a contract as a table."""
    rows = [(part, k, name) for part, names in vars(contract).items() for k, name in enumerate(names, 1)]
    return spark.createDataFrame(rows, "part string, position int, feature string")


def contract_of(rows: DataFrame) -> FeatureContract:
    """The contract that ``contract_rows`` wrote down."""
    found: dict[str, list[str]] = {part: [] for part in FeatureContract.__dataclass_fields__}
    for r in rows.orderBy("part", "position").collect():  # names only
        found[r["part"]].append(r["feature"])
    return FeatureContract(**{part: tuple(names) for part, names in found.items()})


def feature_columns(df: DataFrame, contract: FeatureContract | None = None, seed: Sequence[str] = SEED_FEATURES) -> list[str]:
    """Columns of the contract that are present, without ``tcn_`` twins of an ``lstm_`` column."""
    cols = [c for c in (contract.final if contract else seed) if c in df.columns]
    return [c for c in cols if not (c.startswith("tcn_") and f"lstm_{c[len('tcn_'):]}" in cols)]
