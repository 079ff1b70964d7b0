"""Settings, tuning and regimes of the classifiers, feature elimination and synthetic rows.

Trees are grown for all models of a call at once (``boosting``): a fold, a regime of a fold and a candidate
setting are keys of one table.  Only settings, tree tables of the models at hand and tables of a few rows come
to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.series import KEY
from tickloom.operators import boosting
from tickloom.operators.backtest import with_costs
from tickloom.operators.boosting import BoostSetting
from tickloom.operators.evaluation import average_precision, roc_auc
from tickloom.operators.signals import search_thresholds, threshold_signal
from tickloom.settings import Settings

# Settings tried by the tuning, in order: depth, learning rate, number of trees, share of rows
# per tree, share of columns per tree, least weight of a leaf, least gain, L1 and L2 penalty.
CANDIDATES = (
    (4, 0.03, 450, 0.80, 0.80, 3, 0.30, 0.25, 1.10), (5, 0.025, 500, 0.82, 0.82, 3, 0.25, 0.20, 1.00),
    (6, 0.02, 600, 0.85, 0.85, 2, 0.20, 0.20, 1.00), (4, 0.02, 700, 0.88, 0.86, 4, 0.35, 0.30, 1.20),
    (5, 0.018, 750, 0.84, 0.84, 2, 0.22, 0.22, 1.05), (3, 0.035, 400, 0.78, 0.78, 5, 0.40, 0.35, 1.30),
    (6, 0.015, 900, 0.80, 0.80, 3, 0.28, 0.28, 1.15), (5, 0.03, 450, 0.90, 0.88, 2, 0.18, 0.15, 0.95),
    (4, 0.04, 350, 0.85, 0.75, 4, 0.45, 0.40, 1.40), (6, 0.025, 550, 0.92, 0.90, 1, 0.12, 0.10, 0.90),
    (7, 0.018, 700, 0.78, 0.82, 3, 0.24, 0.20, 1.30), (5, 0.015, 950, 0.86, 0.88, 2, 0.20, 0.18, 1.05),
    (3, 0.025, 600, 0.82, 0.72, 6, 0.50, 0.45, 1.50), (6, 0.03, 420, 0.88, 0.92, 2, 0.16, 0.12, 0.85),
    (4, 0.018, 820, 0.76, 0.80, 5, 0.34, 0.30, 1.25), (5, 0.022, 680, 0.90, 0.78, 3, 0.26, 0.22, 1.00),
    (7, 0.014, 1000, 0.80, 0.86, 2, 0.22, 0.25, 1.20), (4, 0.028, 500, 0.94, 0.94, 2, 0.10, 0.08, 0.80),
    (3, 0.02, 780, 0.88, 0.76, 7, 0.55, 0.55, 1.60), (8, 0.012, 1100, 0.74, 0.78, 3, 0.30, 0.22, 1.30),
    (2, 0.05, 320, 0.90, 0.90, 8, 0.60, 0.60, 1.80), (6, 0.017, 760, 0.84, 0.90, 1, 0.14, 0.10, 0.95),
    (5, 0.027, 540, 0.87, 0.83, 4, 0.29, 0.27, 1.10), (4, 0.016, 980, 0.79, 0.79, 6, 0.38, 0.34, 1.35),
    (7, 0.02, 620, 0.91, 0.87, 2, 0.18, 0.14, 0.92), (6, 0.01, 1300, 0.82, 0.82, 4, 0.25, 0.20, 1.15),
    (5, 0.035, 360, 0.93, 0.90, 2, 0.11, 0.10, 0.88), (3, 0.03, 520, 0.81, 0.74, 7, 0.52, 0.50, 1.55),
    (8, 0.015, 900, 0.76, 0.84, 3, 0.27, 0.23, 1.22),
)
BUDGET = {"low": 8, "medium": 18, "high": 30}


@dataclass(frozen=True)
class TuningGates:
    """Gates and weights of the tuning score."""

    min_trades: int = 8
    net_return_floor: float = -0.002
    w_net_sharpe: float = 0.60
    w_coverage: float = 0.20
    w_auc: float = 0.15
    w_turnover: float = 0.05
    turnover_target: float = 0.12
    floor_penalty: float = 2.50
    loss_penalty: float = 0.20
    eps: float = 0.002
    patience: int = 2


def tuning_candidates(budget: str = "medium", limit: int | None = None) -> list[BoostSetting]:
    """Settings of a budget; deep trees that also learn fast are left out."""
    safe = [BoostSetting(*c) for c in CANDIDATES if not (c[0] >= 7 and c[1] >= 0.03)]
    return safe[: max(1, BUDGET.get((budget or "medium").lower(), BUDGET["medium"]) if limit is None else limit)]


def effective_seed(base: int, fold: int = 0, candidate: int = 0, stochastic: bool = False) -> int:
    return base + fold * 100 + candidate if stochastic else base


# --- regimes and features ------------------------------------------------------------------------

def with_sides(rows: DataFrame, keys: Sequence[str] = ("fold",), least: int = 126) -> DataFrame:
    """``side``: high or low by ``high_vol``; all where a side has fewer than ``least`` training rows in the fold."""
    train = F.col("role") == "train"
    counts = rows.groupBy(*keys).agg(F.count_if(train & F.col("high_vol")).alias("_high"), F.count_if(train & ~F.col("high_vol")).alias("_low"))
    split = (F.col("_high") >= least) & (F.col("_low") >= least)
    return rows.join(counts, list(keys)).withColumn(
        "side", F.when(~split, "all").when(F.col("high_vol"), "high").otherwise("low")).drop("_high", "_low")


def feature_importance(trees: DataFrame, features: Sequence[str], keys: Sequence[str] = ("fold",), top: int = 15) -> DataFrame:
    """Features of one model by importance, the ``top`` first; ``weak`` marks those below one percent."""
    return boosting.importance(trees, features, keys).select(
        "feature", "importance", (F.col("importance") < 0.01).alias("weak")).orderBy(F.desc("importance"), "feature").limit(top)


def eliminate_features(rows: DataFrame, features: Sequence[str], keep: int = 12, trees: int = 100, depth: int = 5, seed: int = 42) -> list[str]:
    """Drop the weakest feature of a random forest, refit, until ``keep`` are left."""
    left = list(features)
    while len(left) > keep:
        data = VectorAssembler(inputCols=left, outputCol="x", handleInvalid="keep").transform(rows.drop("x"))
        forest = RandomForestClassifier(featuresCol="x", labelCol="target", numTrees=trees, maxDepth=depth, seed=seed).fit(data)
        left.pop(int(np.argmin(forest.featureImportances.toArray())))
    return left


# --- synthetic minority rows -------------------------------------------------------------------

def _nearest(y: np.ndarray, rows: np.ndarray, k: int, block: int = 256) -> np.ndarray:
    """Indices in ``y`` of the ``k`` nearest other rows of each of the ``rows`` of ``y``, a block of them at a time."""
    parts = []
    for at in range(0, len(rows), block):
        some = rows[at:at + block]
        d = ((y[some][:, None, :] - y[None, :, :]) ** 2).sum(axis=2)
        d[np.arange(len(some)), some] = np.inf
        parts.append(np.argsort(d, axis=1, kind="stable")[:, :k])
    return np.concatenate(parts)


def _between(x: np.ndarray, base: np.ndarray, k: int, rng) -> np.ndarray:
    near = _nearest(x, np.arange(len(x)), k)
    picked = x[near[base, rng.integers(0, near.shape[1], len(base))]]
    return x[base] + (picked - x[base]) * rng.random((len(base), 1))


def synthetic_minority(rows: DataFrame, features: Sequence[str], seed: int = 42) -> DataFrame:
    """Training rows plus interpolated rows of the smaller class, per (ticker, fold).

    More are made near rows of the other class, up to .95 of its size; when no row has such a
    neighbour they are spread evenly up to .9.  Distances are worked out in blocks of rows.
    """
    cols = list(features)
    schema = f"{KEY} string, fold int, {', '.join(f'`{c}` double' for c in cols)}, target double, synthetic boolean"

    def balance(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(synthetic=False)
        counts = pdf["target"].value_counts()
        if len(counts) < 2:
            return pdf
        small, large = counts.idxmin(), counts.max()
        x, mine = pdf[cols].to_numpy(float), (pdf["target"] == small).to_numpy()
        own = x[mine]
        k = min(4, max(1, int((pdf["target"] == 0).sum()) - 1), len(own) - 1)
        rng = np.random.default_rng([seed, int(pdf["fold"].iloc[0]), *map(ord, pdf[KEY].iloc[0])])
        if k < 1:
            return pdf
        other_share = (~mine)[_nearest(x, np.flatnonzero(mine), k)].mean(axis=1)
        wanted = int(0.95 * large) - len(own)
        if wanted > 0 and other_share.sum() > 0:
            base = np.repeat(np.arange(len(own)), np.rint(other_share / other_share.sum() * wanted).astype(int))
        else:
            base = rng.integers(0, len(own), max(0, int(0.9 * large) - len(own)))
        if not len(base):
            return pdf
        made = pd.DataFrame(_between(own, base, k, rng), columns=cols)
        made = made.assign(target=small, synthetic=True, fold=pdf["fold"].iloc[0])
        made[KEY] = pdf[KEY].iloc[0]
        return pd.concat([pdf, made], ignore_index=True)

    return rows.select(KEY, "fold", *cols, "target").groupBy(KEY, "fold").applyInPandas(balance, schema)


# --- tuning ------------------------------------------------------------------------------------

def candidate_scores(scored: DataFrame, keys: Sequence[str], s: Settings = Settings(), gates: TuningGates = TuningGates()) -> DataFrame:
    """Tuning score of every candidate over validation rows with ``p`` and ``ret``; one row per ``keys``.

    The threshold search ignores costs, the score charges them.  ``discarded`` names the gate a
    candidate failed.
    """
    free = s.with_(cost_bps=0.0, slippage_bps=0.0, search_min_trades=gates.min_trades, search_mode="grid", risk_profile="balanced")
    found = search_thresholds(scored, keys, free)
    rows = threshold_signal(scored.join(found, list(keys)), F.col("threshold_buy"), "size")
    rows = with_costs(rows.withColumn("size", F.col("size").cast("double")), keys, s)
    sd = F.stddev_pop("net")
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("trades"), F.sum("net").alias("net_return"),
        F.when(sd > 1e-12, F.avg("net") / (sd + 1e-12) * np.sqrt(252.0)).otherwise(0.0).alias("net_sharpe"),
        F.coalesce(F.first("stats.turnover"), F.lit(0.0)).alias("turnover"), F.first("threshold_buy").alias("threshold_buy"),
    )
    out = base.join(roc_auc(scored, keys), list(keys)).join(average_precision(scored, keys), list(keys))
    ratio, trades = F.col("trades") / F.col("n"), F.col("trades")
    excess = F.greatest(F.lit(0.0), F.col("turnover") / F.col("n") - gates.turnover_target)
    gap = F.abs(ratio - s.target_coverage) / max(s.target_coverage, 1e-6)
    enough = gates.min_trades * 1.5
    score = (
        gates.w_net_sharpe * F.tanh(F.col("net_sharpe") / 3) + gates.w_coverage * F.greatest(F.lit(0.0), 1 - gap)
        + gates.w_auc * (0.7 * F.col("aucpr") + 0.3 * F.col("auc")) - (gates.w_turnover + s.turnover_penalty) * excess
        - gates.floor_penalty * F.pow(F.greatest(F.lit(0.0), s.trade_ratio_floor - ratio), 2)
        - 0.05 * F.greatest(F.lit(0.0), (enough - trades) / max(1.0, enough))
        - F.when(F.col("net_return") <= 0, gates.loss_penalty).otherwise(0.0)
    )
    return out.withColumn(
        "discarded",
        F.when(trades < gates.min_trades, "min_trades")
        .when(ratio < max(s.trade_ratio_floor, s.min_trades_ratio), "trade_ratio_floor")
        .when(F.col("net_return") <= gates.net_return_floor, "net_return_floor"),
    ).withColumn("score", score)


def _compared(scores: Sequence[tuple[int, float | None]], gates: TuningGates) -> tuple[int | None, bool]:
    best, chosen, idle = -np.inf, None, 0
    for number, value in sorted(scores):
        if value is None:
            continue
        if value > best + gates.eps:
            best, chosen, idle = value, number, 0
        else:
            idle += 1
            if idle >= gates.patience:
                return chosen, True
    return chosen, False


def pick_candidate(scores: Sequence[tuple[int, float | None]], gates: TuningGates = TuningGates()) -> int | None:
    """First-to-last over the at most 30 candidates: a better one must gain ``eps``; stop after
    ``patience`` that do not.  Discarded candidates (score None) are passed over."""
    return _compared(scores, gates)[0]


def stopped(scores: Sequence[tuple[int, float | None]], gates: TuningGates = TuningGates()) -> bool:
    """Whether the comparison ended before the last candidate's turn, so that later ones play no part."""
    return _compared(scores, gates)[1]


def tune(
    rows: DataFrame, features: Sequence[str], settings: Sequence[BoostSetting], keep: Callable[[DataFrame, str], DataFrame],
    s: Settings = Settings(), seed: int = 42, gates: TuningGates = TuningGates(), wave: int = 8,
) -> tuple[BoostSetting | None, DataFrame]:
    """Fit settings on one fold's rows (features, ``target``, ``role``, ``weight``, ``ret``) and pick by the mean score over tickers.

    Candidates are grown and scored ``wave`` at a time, each wave as one table.  They are compared in order, and
    when ``patience`` of them in a row did not gain, those of later waves are never grown.  A setting that fails
    its gates on half of the tickers or more is discarded: its mean would be that of the few that it suits.
    """
    val, found, table = rows.filter(F.col("role") == "val"), [], []
    for at in range(0, len(settings), wave):
        numbers = list(range(at, min(at + wave, len(settings))))
        trees = keep(boosting.fit(rows, features, keep, ("fold",), settings[at:at + wave], numbers, seed), "candidate-trees")
        each = val.withColumn("candidate", F.explode(F.array(*[F.lit(n) for n in numbers])))
        scored = keep(boosting.score(each, trees, features, ("fold", "candidate"), "p"), "candidate-scores")
        per_ticker = candidate_scores(scored, ["candidate", KEY, "fold"], s, gates)
        grown = trees.groupBy("candidate").agg(F.count(F.lit(1)).alias("n_grown"), F.count_if("kept").alias("n_trees"), F.max("aucpr").alias("best_aucpr"))
        summary = per_ticker.groupBy("candidate").agg(
            F.when(
                2 * F.count_if(F.col("discarded").isNull()) > F.count(F.lit(1)), F.avg(F.when(F.col("discarded").isNull(), F.col("score"))),
            ).alias("score"),
            F.count_if(F.col("discarded").isNotNull()).alias("n_discarded"), F.avg("auc").alias("auc"), F.avg("aucpr").alias("aucpr"),
        ).join(grown, "candidate")
        found.append(keep(summary, "candidate-summary"))
        table += [(r["candidate"], r["score"]) for r in found[-1].collect()]  # one row per candidate, at most 30
        if stopped(table, gates):
            break
    number = pick_candidate(table, gates)
    summary = found[0]
    for part in found[1:]:
        summary = summary.unionByName(part)
    return (None if number is None else settings[number]), summary
