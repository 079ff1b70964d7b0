"""Column statistics, correlations and drift of a feature table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.series import ROW

def column_profile(df: DataFrame, cols: Sequence[str], distinct: bool = False) -> DataFrame:
    """Count, mean, deviation, range and a constant flag, one row per column: one aggregation
    with a partial row per task."""
    parts = []
    for c in cols:
        v = F.col(c).cast("double")
        sd = F.stddev_samp(v)
        parts.append(F.struct(
            F.lit(c).alias("feature"), F.count(v).alias("count"), F.avg(v).alias("mean"), sd.alias("std"), F.min(v).alias("min"),
            F.max(v).alias("max"), F.coalesce(sd < 1e-6, F.lit(True)).alias("constant"),
        ))
    out = df.agg(F.array(*parts).alias("s")).select(F.inline("s"))
    return out.join(distinct_values(df, cols), "feature") if distinct else out


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact number of different values per column.

    All columns share one shuffle of (column, value) pairs, deduplicated on the map side; it
    carries every different value, so ask for it only where the number itself is wanted.
    """
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols
    ])).alias("s")).select("s.*").filter("value is not null")
    return pairs.distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("n_distinct"))


def drift(df: DataFrame, cols: Sequence[str], n: int = 100) -> DataFrame:
    """Mean of the first and the last ``n`` rows of each ticker (numbered rows) and its change."""
    last = df.groupBy("ticker").agg(F.max(ROW).alias("_last"))
    early, late = F.col(ROW) <= n, F.col(ROW) > F.col("_last") - n
    parts = []
    for c in cols:
        a, b = F.avg(F.when(early, F.col(c))), F.avg(F.when(late, F.col(c)))
        parts.append(F.struct(F.lit(c).alias("feature"), a.alias("first_mean"), b.alias("last_mean"), F.abs(b - a).alias("change")))
    rows = df.select("ticker", ROW, *cols).join(last, "ticker").filter(early | late)
    return rows.groupBy("ticker").agg(F.array(*parts).alias("a")).select("ticker", F.explode("a").alias("s")).select("ticker", "s.*")


def last_values(df: DataFrame, cols: Sequence[str], n: int = 5) -> DataFrame:
    """(ticker, feature, rn, value): the values of the last ``n`` rows of each ticker (numbered rows)."""
    last = df.groupBy("ticker").agg(F.max(ROW).alias("_last"))
    rows = df.select("ticker", ROW, *cols).join(last, "ticker").filter(F.col(ROW) > F.col("_last") - n)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols]))
    return rows.select("ticker", ROW, each.alias("s")).select("ticker", "s.feature", ROW, "s.value")


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson correlation of every pair over the rows that have both values; null when one
    of them does not vary.

    Every task adds up its rows into one set of sums per pair (matrix products over Arrow
    batches), so the shuffle carries one row per pair and partition however long the table is.
    """
    cols = list(dict.fromkeys(c for pair in pairs for c in pair))
    data = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    centre = np.array([v or 0.0 for v in data.agg(*[F.avg(c) for c in cols]).first()])  # keeps the sums small
    left, right = ([cols.index(pair[side]) for pair in pairs] for side in (0, 1))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = len(cols)
        total = np.zeros((4, n, n))
        for batch in batches:
            x = batch.to_numpy(float) - centre
            known = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            total += np.stack([known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x])
        count, sx, sxx, sxy = total
        yield pd.DataFrame({
            "pair": np.arange(len(left)), "n": count[left, right], "sx": sx[left, right], "sy": sx[right, left],
            "sxx": sxx[left, right], "syy": sxx[right, left], "sxy": sxy[left, right],
        })

    schema = "pair int, n double, sx double, sy double, sxx double, syy double, sxy double"
    added = data.mapInPandas(sums, schema).groupBy("pair").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    vx, vy = F.col("sxx") * n - sx * sx, F.col("syy") * n - sy * sy
    varied = (vx > 1e-14 * n * F.col("sxx")) & (vy > 1e-14 * n * F.col("syy"))
    r = F.when(varied, (F.col("sxy") * n - sx * sy) / F.sqrt(vx * vy))
    name = [F.array(*[F.lit(pair[side]) for pair in pairs]) for side in (0, 1)]
    return added.select(name[0][F.col("pair")].alias("a"), name[1][F.col("pair")].alias("b"), r.alias("r"))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return correlations(df, list(combinations(cols, 2)))


def high_correlations(df: DataFrame, left: Sequence[str], right: Sequence[str], limit: float = 0.7) -> DataFrame:
    """Pairs between two groups of columns with a correlation beyond ``limit``."""
    return correlations(df, list(product(left, right))).filter(F.abs("r") > limit)
