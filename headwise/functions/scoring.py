"""Score and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from headwise.config import ReliabilityConfig


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division with 0 where it is undefined."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def pct_of_sums(part: str, whole: str) -> Column:
    """Aggregate: 100 * sum(part) / sum(whole)."""
    return ratio(F.lit(100.0) * F.sum(part), F.sum(whole))


def reliability_score(cov: Column, bunching_rate: Column, gap_rate: Column, cfg: ReliabilityConfig) -> Column:
    def capped(rate: Column) -> Column:
        return F.least(rate, F.lit(cfg.rate_cap)) / F.lit(cfg.rate_cap)

    penalty = (
        F.least(cov, F.lit(1.0)) * cfg.weight_cov
        + capped(bunching_rate) * cfg.weight_bunching
        + capped(gap_rate) * cfg.weight_gap
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) * (F.lit(1.0) - penalty)))


def score_band(score: Column) -> Column:
    # Red below 40, amber below 70, green from there.
    return F.when(score < 40, "red").when(score < 70, "amber").otherwise("green")


def trend_direction(trend: Column) -> Column:
    # Changes within 0.05 points count as flat.
    return F.when(trend > 0.05, "up").when(trend < -0.05, "down").otherwise("flat")


def rank_key(value: Column) -> Column:
    """A sort key for computed doubles: sums may differ in the last bits between runs, ranks must not."""
    return F.round(value, 9)
