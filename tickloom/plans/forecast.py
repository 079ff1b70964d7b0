"""A whole forecast run over the panel: folds, fitted models, signals, backtest, decision."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.series import KEY, ROW, div
from tickloom.operators import backtest, boosting, calibration, evaluation, folds, models, recommendation, sequences, signals
from tickloom.plans.market import Market
from tickloom.settings import Settings


@dataclass
class Forecast:
    predictions: DataFrame      # one row per validation row: p_raw (calibrated) and p_model
    results: DataFrame          # one row per (ticker, fold), with its calibration
    skipped: DataFrame          # (ticker, fold, reason)
    runs: DataFrame             # one row per ticker
    recommendations: DataFrame  # one row per ticker
    trees: DataFrame            # one row per (model, tree)


def training_rows(members: DataFrame, features: Sequence[str], s: Settings = Settings()) -> DataFrame:
    """Usable fold rows with scaled features, class weights and the inputs of the signals.

    ``volatility_20`` and ``distance_to_ma200`` keep their raw values next to the scaled ones
    (named ``x_*``), as gates and sizes compare raw values.
    """
    usable = folds.skip_reasons(members, s).filter("reason is null").select(*folds.FOLD)
    weights = folds.class_weights(members).select(*folds.FOLD, "pos_weight")
    fold = Window.partitionBy(*folds.FOLD)
    order = Window.partitionBy(*folds.FOLD, "role").orderBy(ROW)
    vol = folds.on_train(F.col("volatility_20"))
    rows = folds.robust_scale(members.withColumns({f"x_{f}": F.col(f) for f in features}), [f"x_{f}" for f in features])
    return rows.withColumns({
        "train_vol_mean": F.avg(vol).over(fold), "train_vol_std": F.stddev_pop(vol).over(fold),
        "n_train": F.count_if(F.col("role") == "train").over(fold),
        "ret": F.coalesce(div(F.lead("close").over(order), F.col("close")) - 1, F.lit(0.0)),
    }).join(weights, list(folds.FOLD)).join(usable, list(folds.FOLD), "left_semi").withColumn(
        "weight", F.when(F.col("target") == 1, F.col("pos_weight")).otherwise(1.0)
    )


def with_fold_sequences(members: DataFrame, inputs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fold rows with the sequence columns learned in their own fold, in place of the neutral ones."""
    neutral = sequences.placeholder_columns(members)
    fresh = sequences.encode_folds(members, inputs)
    made = sequences.overwrite_columns(neutral, fresh, list(columns), (KEY, "fold", ROW))
    return made.select(*members.columns, *columns)


def fold_rows(market: Market, s: Settings = Settings(), scheme: str = "sliding") -> tuple[DataFrame, list[str]]:
    """The stage of training rows over the feature contract, and the names of its scaled columns."""
    technical, learned = market.training_features()
    payload = market.payload(settings=repr(s), scheme=scheme, features=[*technical, *learned])

    def build() -> DataFrame:
        members = market.members(s, scheme, technical)
        encoded = market.stages.table("fold_sequences", payload, lambda: with_fold_sequences(members, market.sequence_inputs(), learned))
        return training_rows(encoded, [*technical, *learned], s)

    return market.stages.table("fold_rows", payload, build), [f"x_{f}" for f in (*technical, *learned)]


def with_synthetic(rows: DataFrame, features: Sequence[str], seed: int) -> DataFrame:
    """Fold rows plus interpolated training rows of the smaller class, weighted like their class."""
    cols = [*folds.FOLD, *features, "target", "role", "weight"]
    made = models.synthetic_minority(rows.filter("role = 'train'"), features, seed).filter("synthetic")
    weights = rows.filter("role = 'train'").groupBy(*folds.FOLD, "target").agg(F.first("weight").alias("weight"))
    made = made.join(weights, [*folds.FOLD, "target"]).withColumn("role", F.lit("train"))
    return rows.select(*cols, ROW).unionByName(made.select(*cols, F.lit(None).cast("long").alias(ROW)))


def keeper(market: Market) -> Callable[[DataFrame, str], DataFrame]:
    """Writes an intermediate table under the shared root and reads it back."""
    def keep(df: DataFrame, name: str) -> DataFrame:
        path = f"{market.stages.root}/steps/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return market.spark.read.schema(df.schema).parquet(path)

    return keep


def forecast(
    market: Market, s: Settings = Settings(), setting: models.BoostSetting = models.BoostSetting(), calibrate: bool = True,
    tune: int = 0, seed: int = 42, regime_split: bool = False, scheme: str = "sliding", group_rows: int = boosting.GROUP_ROWS,
) -> Forecast:
    """Grow one panel model per fold and carry its scores through to one decision per ticker.

    Models train on the feature contract, sequence columns being learned inside each fold.  All folds are
    grown, scored and calibrated as one table each.  ``tune`` tries that many settings on the first fold and
    reuses the choice.  Profiles other than conservative train on balanced classes.  ``regime_split`` grows a
    calm and a volatile model instead of one, without calibration.  ``scheme`` is sliding or purged.  The
    number of trees is the setting's, less where the validation rows stop improving.
    """
    data, names = fold_rows(market, s, scheme)
    payload = market.payload(settings=repr(s), features=names, setting=repr(setting), calibrate=calibrate, tune=tune, seed=seed,
                             regime_split=regime_split, scheme=scheme)
    keep = keeper(market)
    chosen = setting
    if tune:
        first = data.agg(F.min("fold")).first()[0]
        if first is not None:
            found, _ = models.tune(data.filter(F.col("fold") == first), names, models.tuning_candidates("medium", tune), keep, s, seed)
            chosen = found or setting
    keys = ("fold", "side") if regime_split else ("fold",)
    rows = models.with_sides(evaluation.high_volatility(data)) if regime_split else data
    learn = rows if regime_split or s.conservative else with_synthetic(data, names, seed)
    ident = (KEY, ROW, *names)  # made rows have no row number
    trees = market.stages.table("trees", payload, lambda: boosting.fit(
        learn, names, keep, keys, (chosen,), seed=seed, ident=ident, group_rows=group_rows))

    def scored() -> DataFrame:
        val = F.col("role") == "val"
        if regime_split or not calibrate:
            found = boosting.score(rows.filter(val), trees, names, keys, "p_model")
            return found.withColumns({"p_raw": F.col("p_model"), "calibration_method": F.lit("none"), "calibration_reason": F.lit("disabled_by_mode_or_config")})
        plan = calibration.planned(data)
        held = calibration.calibration_rows(data.filter("role = 'train'").join(plan.select("fold", "share"), "fold"), F.col("share")).drop("share")
        both = keep(boosting.score(data.filter(val).unionByName(held), trees, names, keys, "p_model"), "scored")
        return calibration.calibrated(both.filter(val), both.filter(~val), plan, keep)

    preds = market.stages.table("model_scores", payload, lambda: scored().drop("weight", "pos_weight", "role", "high_vol", "side"))
    adjusted = signals.volatility_weighted(preds)
    sized = signals.open_positions(adjusted, signals.fold_thresholds(adjusted, s=s), s=s)

    def fold_table() -> DataFrame:
        return backtest.fold_results(sized, s=s).join(calibration.quality(preds, folds.FOLD), list(folds.FOLD))

    results = market.stages.table("model_results", payload, fold_table)
    checks = folds.skip_reasons(market.members(s, scheme, market.training_features()[0]), s).filter("reason is not null")
    unused = checks.select(KEY, "fold", "reason")
    skipped = unused.unionByName(results.filter("reason is not null").select(KEY, "fold", "reason"))
    # Folds that were skipped before a fit count as configured, too.
    configured = results.unionByName(unused, allowMissingColumns=True)
    runs = backtest.cross_fold_metrics(configured).join(backtest.calibration_summary(results), KEY, "left")
    last = recommendation.latest_bar(market.features())
    future = recommendation.latest_fold_probability(preds, last, "p_model")
    return Forecast(
        preds, results, skipped, runs,
        recommendation.recommend(recommendation.ensemble_summary(future, last), last, s), trees,
    )
