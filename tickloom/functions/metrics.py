"""Aggregate expressions over one group of rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.series import div

RISK_FREE = 0.02


def sharpe(returns: Column, risk_free: float = RISK_FREE) -> Column:
    """Yearly Sharpe ratio; null below two rows or without variation."""
    sd = F.stddev_pop(returns)
    ratio = (F.avg(returns) - risk_free / 252) / F.when(sd >= 1e-10, sd) * math.sqrt(252)
    return F.when(F.count(returns) >= 2, ratio)


def robust(mean: Column, sd: Column, weight: float) -> Column:
    """Mean less ``weight`` deviations; a single run has no deviation and counts as 0."""
    return mean - weight * F.coalesce(sd, F.lit(0.0))


def brier(y: Column, p: Column) -> Column:
    return F.avg(F.pow(p - y, 2))


def expected_value(p: Column, tp: Column, sl: Column, cost: Column | float) -> Column:
    cost = cost if isinstance(cost, Column) else F.lit(cost)
    return p * tp - (1 - p) * F.abs(sl) - cost


def precision_recall(hit: Column, called: Column, positive: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 from 0/1 columns, with small terms instead of zero divisors."""
    precision = F.sum(hit) / (F.sum(called) + 1e-6)
    recall = F.sum(hit) / (F.sum(positive) + 1e-6)
    return precision, recall, 2 * precision * recall / (precision + recall + 1e-6)


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(div(a, b), F.lit(0.0))
