"""Data-quality checks. Each returns one row per check (check, value, passed) and never fails by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwise.functions import scoring
from headwise.operators import quantiles

# The bounds that published tables are expected to meet.
MEDIAN_HEADWAY_MIN = (4.0, 20.0)
BUNCHING_RATE = (0.0, 0.4)
MIN_DATES = 25
MOVING_TREND = 0.001
MOVING_SHARE = 0.8
DWELL_MIN_AT_MOST = 35.0
DWELL_MAX_AT_LEAST = 90.0
DWELL_STD_ABOVE = 12.0
CLEAN_PERCENTAGES = [25.0, 33.3, 50.0, 66.7]
CLEAN_MIN_TRIPS = 200


def _check(stats: DataFrame, name: str, passed: Column) -> DataFrame:
    """`stats` has one row with `value`; an undefined value does not pass."""
    return stats.select(
        F.lit(name).alias("check"),
        F.col("value").cast("double").alias("value"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
    )


def quality_checks(routes: DataFrame, segments: DataFrame) -> DataFrame:
    value = F.col("value")
    median_headway = quantiles.median(routes, "mean_headway")
    bunching = (
        segments.groupBy("route_id").agg(F.avg("bunching_rate").alias("rate")).agg(F.max("rate").alias("value"))
    )
    dwell = segments.agg(F.stddev_samp("mean_dwell_sec").alias("value"))
    # One row per date carries both the number of dates and the latest date's share of moving trends.
    per_date = routes.groupBy("date").agg(
        F.avg((F.abs("wow_trend") > MOVING_TREND).cast("int")).alias("moving_share")
    )
    by_date = per_date.agg(F.count("date").alias("dates"), F.max_by("moving_share", "date").alias("moving")).select(
        F.inline(
            F.array(
                _named("distinct_dates", "dates", F.col("dates") >= MIN_DATES),
                _named("moving_trend_share", "moving", F.col("moving") > MOVING_SHARE),
            )
        )
    )
    return (
        _check(median_headway, "median_headway_min", value.between(*MEDIAN_HEADWAY_MIN))
        .unionByName(_check(bunching, "max_route_bunching_rate", value.between(*BUNCHING_RATE)))
        .unionByName(_check(dwell, "dwell_std", value > 0))
        .unionByName(by_date)
    )


def dwell_spread(routes: DataFrame) -> DataFrame:
    """Spread of the routes' mean dwell times."""
    value = F.col("value")
    spread = (
        routes.groupBy("route_id")
        .agg(F.avg("mean_dwell_sec").alias("dwell"))
        .agg(F.min("dwell").alias("low"), F.max("dwell").alias("high"), F.stddev_samp("dwell").alias("std"))
    )
    return spread.select(
        F.inline(
            F.array(
                _named("route_dwell_min", "low", F.col("low") <= DWELL_MIN_AT_MOST),
                _named("route_dwell_max", "high", F.col("high") >= DWELL_MAX_AT_LEAST),
                _named("route_dwell_std", "std", F.col("std") > DWELL_STD_ABOVE),
            )
        )
    ).select("check", value, "passed")


def _named(name: str, column: str, passed: Column) -> Column:
    return F.struct(
        F.lit(name).alias("check"),
        F.col(column).cast("double").alias("value"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
    )


def clean_fraction_check(segments: DataFrame, min_trips: int = CLEAN_MIN_TRIPS) -> DataFrame:
    """Stops whose all-days rates are suspiciously round, one row per stop with enough trips."""
    totals = (
        segments.groupBy("route_id", "stop_id")
        .agg(
            F.sum("bunching_count").alias("bunching_count"),
            F.sum("gap_count").alias("gap_count"),
            F.sum("total_trips").alias("total_trips"),
        )
        .where(F.col("total_trips") >= min_trips)
    )

    def pct(count: str) -> Column:
        return F.round(scoring.ratio(F.col(count), F.col("total_trips")) * 100, 1)

    return totals.select(
        "route_id",
        "stop_id",
        "total_trips",
        pct("bunching_count").alias("bunching_pct"),
        pct("gap_count").alias("gap_pct"),
    ).withColumn(
        "passed", ~(F.col("bunching_pct").isin(CLEAN_PERCENTAGES) | F.col("gap_pct").isin(CLEAN_PERCENTAGES))
    )


def describe(df: DataFrame, *columns: str) -> DataFrame:
    """Count, mean, std, min, quartiles and max, one row per column."""
    rows = None
    for column in columns:
        base = df.agg(
            F.lit(column).alias("metric"),
            F.count(column).alias("count"),
            F.avg(column).alias("mean"),
            F.stddev_samp(column).alias("std"),
            F.min(column).alias("min"),
            F.max(column).alias("max"),
        )
        quartiles = (
            quantiles.percentiles(df, column, [0.25, 0.5, 0.75])
            .groupBy(F.lit(column).alias("metric"))
            .agg(
                F.max(F.when(F.col("probability") == 0.25, F.col("value"))).alias("q1"),
                F.max(F.when(F.col("probability") == 0.5, F.col("value"))).alias("median"),
                F.max(F.when(F.col("probability") == 0.75, F.col("value"))).alias("q3"),
            )
        )
        row = base.join(quartiles, "metric").select(
            "metric", "count", "mean", "std", "min", "q1", "median", "q3", "max"
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows


def all_checks(routes: DataFrame, segments: DataFrame, min_trips: int = CLEAN_MIN_TRIPS) -> DataFrame:
    """Every check of the published tables, a row each: check, value, passed."""
    clean = clean_fraction_check(segments, min_trips).agg(F.count_if(~F.col("passed")).alias("value"))
    return (
        quality_checks(routes, segments)
        .unionByName(dwell_spread(routes))
        .unionByName(_check(clean, "stops_with_round_rates", F.col("value") == 0))
    )
