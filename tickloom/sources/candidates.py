"""Candidate settings from a JSON list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.selection import normalize_candidates

FIELDS = (
    "id", "target_coverage", "trade_ratio_floor", "conservative_th_min", "conservative_th_max", "calibration_method",
    "conservative_percentile_threshold", "xgb_stochastic_mode", "xgb_candidate_budget",
)


def read_candidates(
    spark: SparkSession, path: str, forced_stochastic: bool | None = None, forced_budget: str | None = None
) -> DataFrame:
    """Normalised candidates of a JSON array of objects; the position in the array names the
    candidates without an id.  A text that is no array is an error."""
    text = spark.read.text(path, wholetext=True)
    items = F.from_json("value", "array<map<string,string>>", {"mode": "FAILFAST"})
    rows = text.select(F.posexplode(items).alias("idx", "c"))
    rows = rows.select("idx", *[F.try_element_at("c", F.lit(f)).alias(f) for f in FIELDS])
    return normalize_candidates(rows, forced_stochastic, forced_budget)
