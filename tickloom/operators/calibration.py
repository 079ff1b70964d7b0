"""Calibration of probabilities for all folds in one plan.

Isotonic: scores are put together by value first, pools of adjacent violators are then merged within ranges of
scores and once more over what each range left; merging pools is associative, so no range has to see another.
Sigmoid: Newton steps, one keyed aggregation each, so all folds take a step together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.series import KEY, ROW, clip
from tickloom.operators.evaluation import brier_score, calibration_error

# Training rows from which isotonic is fitted, and from which anything is; shares of the
# training rows that are held for calibration; rows a calibrator needs; error that raises the alarm.
LARGE, SMALL, LARGE_SHARE, SMALL_SHARE, LEAST_ROWS, ALARM = 300, 180, 0.20, 0.15, 60, 0.35
#: Ranges of scores that are pooled side by side.
RANGES = 64
STEPS = 12


def calibration_rows(scored: DataFrame, ratio: float | Column = 0.2, keys: Sequence[str] = (KEY, "fold")) -> DataFrame:
    """The last part of each fold's training rows, kept only with at least 100 rows in the
    fold, 30 in the part and both classes in it."""
    ratio = F.least(F.lit(0.30), F.greatest(F.lit(0.10), F.lit(ratio) if isinstance(ratio, float) else ratio))
    order, whole = Window.partitionBy(*keys).orderBy(ROW), Window.partitionBy(*keys)
    part = scored.withColumns({
        "_k": F.row_number().over(order), "_n": F.count(F.lit(1)).over(whole),
    }).filter((F.col("_n") >= 100) & (F.col("_k") > F.floor(F.col("_n") * (1 - ratio))))
    return part.withColumns({
        "_m": F.count(F.lit(1)).over(whole), "_lo": F.min("target").over(whole), "_hi": F.max("target").over(whole),
    }).filter((F.col("_m") >= 30) & (F.col("_lo") < F.col("_hi"))).drop("_k", "_n", "_m", "_lo", "_hi")


def clip_probability(p: Column) -> Column:
    return clip(p, 1e-6, 1 - 1e-6)


def by_score(rows: DataFrame, keys: Sequence[str], p: str = "p_raw", y: str = "target") -> DataFrame:
    """(keys, p, positives, n): one row per different score."""
    return rows.filter(F.col(p).isNotNull()).groupBy(*keys, F.col(p).alias("p")).agg(F.sum(y).alias("positives"), F.count(F.lit(1)).alias("n"))


def pools(low: np.ndarray, high: np.ndarray, positives: np.ndarray, n: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Adjacent pools in order of score, merged until their means rise."""
    done: list[list[float]] = []
    for a, b, s, c in zip(low.tolist(), high.tolist(), positives.tolist(), n.tolist(), strict=True):
        done.append([a, b, s, c])
        # Compared as products of counts, which are exact.
        while len(done) > 1 and done[-2][2] * done[-1][3] >= done[-1][2] * done[-2][3]:
            _, b2, s2, c2 = done.pop()
            top = done[-1]
            top[1], top[2], top[3] = b2, top[2] + s2, top[3] + c2
    return [tuple(d) for d in done]


def isotonic(counts: DataFrame, keys: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """(keys, low, high, value): steps of the isotonic fit on ``by_score`` rows, without gaps in their order."""
    kinds = ", ".join(f"{k} {counts.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, low double, high double, positives double, n double"

    def merged(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("low", kind="stable")
        found = pools(*(frame[c].to_numpy(float) for c in ("low", "high", "positives", "n")))
        out = pd.DataFrame(found, columns=["low", "high", "positives", "n"])
        for name, value in zip(keys, key):
            out.insert(0, name, value)
        return out[[*keys, "low", "high", "positives", "n"]]

    rows = counts.select(
        *keys, F.least(F.greatest(F.floor(F.col("p") * ranges), F.lit(0)), F.lit(ranges - 1)).alias("_range"),
        F.col("p").alias("low"), F.col("p").alias("high"), F.col("positives").cast("double").alias("positives"), F.col("n").cast("double").alias("n"))
    within = rows.groupBy(*keys, "_range").applyInPandas(lambda key, frame: merged(key[:len(keys)], frame), schema)
    whole = within.groupBy(*keys).applyInPandas(merged, schema)
    return whole.select(*keys, "low", "high", (F.col("positives") / F.col("n")).alias("value"))


def apply_isotonic(rows: DataFrame, steps: DataFrame, keys: Sequence[str], p: str = "p_raw", out: str = "p_isotonic") -> DataFrame:
    """Scores inside a step take its value, between steps the line between them, outside the nearest value.

    Null where the keys have no steps.  Steps and different scores are laid side by side in order of score.
    """
    ends = steps.select(*keys, F.explode(F.array_distinct(F.array("low", "high"))).alias("_x"), F.col("value").alias("_v"))
    asked = rows.filter(F.col(p).isNotNull()).select(*keys, F.col(p).alias("_x")).distinct().withColumn("_v", F.lit(None).cast("double"))
    order = Window.partitionBy(*keys).orderBy("_x", F.col("_v").isNull())
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col("_v").isNotNull(), F.struct("_x", "_v"))
    near = ends.unionByName(asked).withColumns({"_a": F.last(point, True).over(before), "_b": F.first(point, True).over(after)}).filter("_v is null")
    share = (F.col("_x") - F.col("_a._x")) / (F.col("_b._x") - F.col("_a._x"))
    line = F.col("_a._v") + (F.col("_b._v") - F.col("_a._v")) * share
    value = F.when(F.col("_a._x") == F.col("_x"), F.col("_a._v")).when(F.col("_a").isNull(), F.col("_b._v")).when(F.col("_b").isNull(), F.col("_a._v")).otherwise(line)
    known = near.select(*keys, F.col("_x").alias(p), clip_probability(value).alias(out))
    return rows.join(known, [*keys, p], "left")


def sigmoid(counts: DataFrame, keys: Sequence[str], steps: int = STEPS, close: float = 1e-12) -> DataFrame:
    """(keys, slope, offset) of a logistic curve on ``by_score`` rows, with an L2 penalty of one half on the slope.

    Every step is one aggregation over the different scores of all folds, of which the driver gets five sums a
    fold; steps start from 0 and end when no fold moves.  ``counts`` is read once a step.
    """
    spark, keys = counts.sparkSession, list(keys)
    kinds = ", ".join(f"{k} {counts.schema[k].dataType.simpleString()}" for k in keys) + ", slope double, offset double"
    found = {tuple(r): (0.0, 0.0) for r in counts.select(*keys).distinct().collect()}  # one row per fold
    p, n = F.col("p"), F.col("n")
    q = 1 / (1 + F.exp(-(F.col("slope") * p + F.col("offset"))))
    error, weight = n * q - F.col("positives"), n * q * (1 - q)
    curves = lambda: spark.createDataFrame([(*k, *v) for k, v in found.items()], kinds)
    for _ in range(steps if found else 0):
        sums = counts.join(curves(), keys).groupBy(*keys).agg(
            F.sum(error * p).alias("ga"), F.sum(error).alias("gb"),
            F.sum(weight * p * p).alias("haa"), F.sum(weight * p).alias("hab"), F.sum(weight).alias("hbb"))
        moved = 0.0
        for r in sums.collect():
            k = tuple(r[c] for c in keys)
            a, b = found[k]
            ga, haa = r["ga"] + a, r["haa"] + 1
            det = haa * r["hbb"] - r["hab"] * r["hab"]
            if det > 1e-12:
                da, db = (r["hbb"] * ga - r["hab"] * r["gb"]) / det, (haa * r["gb"] - r["hab"] * ga) / det
                found[k], moved = (a - da, b - db), max(moved, abs(da), abs(db))
        if moved < close:
            break
    return curves()


def apply_sigmoid(rows: DataFrame, curves: DataFrame, keys: Sequence[str], p: str = "p_raw", out: str = "p_sigmoid") -> DataFrame:
    value = clip_probability(1 / (1 + F.exp(-(F.col("slope") * F.col(p) + F.col("offset")))))
    return rows.join(curves, list(keys), "left").withColumn(out, value).drop("slope", "offset")


def planned(members: DataFrame, keys: Sequence[str] = ("fold",), large: int = LARGE, small: int = SMALL) -> DataFrame:
    """(keys, method, share) by the number of training rows; null where there are too few to calibrate."""
    rows = F.count_if(F.col("role") == "train")
    return members.groupBy(*keys).agg(rows.alias("_n")).select(
        *keys, F.when(F.col("_n") >= large, "isotonic").when(F.col("_n") >= small, "sigmoid").alias("method"),
        F.when(F.col("_n") >= large, LARGE_SHARE).otherwise(SMALL_SHARE).alias("share"))


def quality(rows: DataFrame, keys: Sequence[str] = ("fold",), p: str = "p_raw") -> DataFrame:
    """(keys, calibration_enabled, calibration_method, calibration_reason, calibration_error, brier) of calibrated rows."""
    method = rows.groupBy(*keys).agg(F.first("calibration_method").alias("calibration_method"), F.first("calibration_reason").alias("calibration_reason"))
    numbers = calibration_error(rows, keys, p).join(brier_score(rows, keys, p), list(keys))
    used = F.col("calibration_method") != "none"
    return method.join(numbers, list(keys)).select(
        *keys, used.alias("calibration_enabled"), "calibration_method", "calibration_reason",
        F.when(used, F.col("ece")).alias("calibration_error"), F.when(used, F.col("brier")).alias("brier"))


def calibrated(
    val: DataFrame, held: DataFrame, plan: DataFrame, keep: Callable[[DataFrame, str], DataFrame], keys: Sequence[str] = ("fold",),
    alert: float = ALARM, p: str = "p_model",
) -> DataFrame:
    """Validation rows with ``p_raw`` (calibrated where that is possible), ``calibration_method`` and ``calibration_reason``.

    ``held`` are scored rows held for calibration, ``plan`` comes from ``planned``, ``keep`` writes a frame and
    reads it back.  Isotonic gives way to
    sigmoid where its error on the validation rows is above ``alert`` and the sigmoid's is smaller.
    """
    keys = list(keys)
    enough = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.count_distinct("target").alias("_classes"))
    state = plan.join(enough, keys, "left").select(
        *keys, "method",
        F.when(F.col("method").isNull(), "disabled_by_mode_or_config").when(F.col("_rows").isNull(), "invalid_calibration_split")
        .when((F.col("_rows") < LEAST_ROWS) | (F.col("_classes") < 2), "insufficient_data_or_single_class").otherwise("ok").alias("_state"))
    counts = keep(by_score(held.join(state.filter("_state = 'ok'").select(*keys), keys, "left_semi"), keys, p), "score-counts")
    both = apply_sigmoid(apply_isotonic(val, isotonic(counts, keys), keys, p), sigmoid(counts, keys), keys, p).join(state, keys, "left")
    both = keep(both, "calibrated")
    ece = [calibration_error(both.filter(f"p_{m} is not null"), keys, f"p_{m}").withColumnRenamed("ece", f"_{m}") for m in ("isotonic", "sigmoid")]
    both = reduce(lambda df, e: df.join(e, keys, "left"), ece, both)
    ready = F.col("_state") == "ok"
    alarm = ready & (F.col("method") == "isotonic") & (F.col("_isotonic") > alert)
    switch = alarm & (F.col("_sigmoid") < F.col("_isotonic"))
    used = F.when(~ready | F.col("_state").isNull(), "none").when(switch, "sigmoid").otherwise(F.col("method"))
    reason = F.when(switch, "fallback_from_isotonic_ece").when(alarm, "ok|sigmoid_not_better").otherwise(F.col("_state"))
    out = both.withColumns({"calibration_method": used, "calibration_reason": F.coalesce(reason, F.lit("disabled_by_mode_or_config"))})
    value = F.when(F.col("calibration_method") == "isotonic", F.col("p_isotonic")).when(F.col("calibration_method") == "sigmoid", F.col("p_sigmoid")).otherwise(F.col(p))
    return out.withColumn("p_raw", value).drop("p_isotonic", "p_sigmoid", "_isotonic", "_sigmoid", "_state", "method")
