"""Daily stop metrics, route scores and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwise.config import DEFAULTS, ReliabilityConfig
from headwise.functions import clock, scoring
from headwise.operators import headway


def segment_metrics(flagged: DataFrame, cfg: ReliabilityConfig = DEFAULTS) -> DataFrame:
    """One row per (route, stop, date). Pings filed under no date have no group.

    Besides the published columns, the schedule that the headways were judged by, as a sum and a count.
    """
    trips = F.col("total_trips")
    return (
        flagged.where(F.col("date").isNotNull())
        .groupBy("route_id", "stop_id", "date")
        .agg(
            F.count("headway_min").alias("total_trips"),
            F.avg("headway_min").alias("mean_headway"),
            F.coalesce(F.stddev_samp("headway_min"), F.lit(0.0)).alias("std_headway"),
            F.count_if("is_bunching").alias("bunching_count"),
            F.count_if("is_gap").alias("gap_count"),
            F.avg("dwell_sec").alias("mean_dwell_sec"),
            F.max("route_base_boardings").alias("route_base_boardings"),
            F.sum("scheduled_headway_min").alias("scheduled_min_sum"),
            F.count("scheduled_headway_min").alias("scheduled_trips"),
        )
        .withColumns(
            {
                "headway_cov": scoring.ratio(F.col("std_headway"), F.col("mean_headway")),
                "bunching_rate": scoring.ratio(F.col("bunching_count"), trips),
                "gap_rate": scoring.ratio(F.col("gap_count"), trips),
            }
        )
        .withColumn(
            "reliability_score",
            scoring.reliability_score(F.col("headway_cov"), F.col("bunching_rate"), F.col("gap_rate"), cfg),
        )
    )


def route_metrics(segments: DataFrame) -> DataFrame:
    """One row per (route, date): every stop counts the same, whatever its trips."""
    return segments.groupBy("route_id", "date").agg(
        F.avg("reliability_score").alias("reliability_score"),
        F.avg("mean_headway").alias("mean_headway"),
        F.sum("bunching_count").alias("bunching_count"),
        F.sum("gap_count").alias("gap_count"),
        F.avg("mean_dwell_sec").alias("mean_dwell_sec"),
        F.max("route_base_boardings").alias("route_base_boardings"),
    )


def wow_trend(routes: DataFrame, cfg: ReliabilityConfig = DEFAULTS) -> DataFrame:
    """Change against the score seven rows (not calendar days) earlier; 0 where there is none."""
    by_date = Window.partitionBy("route_id").orderBy("date")
    earlier = F.lag("reliability_score", cfg.wow_lag_rows).over(by_date)
    return routes.withColumn("prev_week_score", F.coalesce(earlier, F.col("reliability_score"))).withColumn(
        "wow_trend", F.col("reliability_score") - F.col("prev_week_score")
    )


def route_scores(segments: DataFrame, cfg: ReliabilityConfig = DEFAULTS) -> DataFrame:
    return wow_trend(route_metrics(segments), cfg)


def segments_from_pings(pings: DataFrame, cfg: ReliabilityConfig = DEFAULTS) -> DataFrame:
    return segment_metrics(headway.flagged_headways(pings, cfg), cfg)


def segment_rollup(segments: DataFrame, min_trips: int = 80) -> DataFrame:
    """All-days view of every stop with enough trips."""
    return (
        segments.groupBy("route_id", "stop_id")
        .agg(
            F.avg("reliability_score").alias("reliability_score"),
            F.sum("total_trips").alias("total_trips"),
            F.sum("bunching_count").alias("bunching_count"),
            F.sum("gap_count").alias("gap_count"),
            F.avg("mean_dwell_sec").alias("mean_dwell_sec"),
            F.max("route_base_boardings").alias("route_base_boardings"),
        )
        .where(F.col("total_trips") >= min_trips)
    )


def latest_trend(routes: DataFrame) -> DataFrame:
    return routes.groupBy("route_id").agg(F.max_by("wow_trend", "date").alias("wow_trend"))


def worst_stop_per_route(segments: DataFrame) -> DataFrame:
    """Each route's stop with the lowest average daily score, with all-days rates in percent."""
    per_stop = segments.groupBy("route_id", "stop_id").agg(
        F.avg("reliability_score").alias("avg_score"),
        scoring.pct_of_sums("bunching_count", "total_trips").alias("bunching_pct"),
        scoring.pct_of_sums("gap_count", "total_trips").alias("gap_pct"),
        F.avg("mean_dwell_sec").alias("mean_dwell_sec"),
    )
    worst = F.min(
        F.struct(
            scoring.rank_key(F.col("avg_score")).alias("key"),
            "stop_id",
            "avg_score",
            "bunching_pct",
            "gap_pct",
            "mean_dwell_sec",
        )
    )
    return (
        per_stop.groupBy("route_id")
        .agg(worst.alias("worst"))
        .select(
            "route_id",
            "worst.stop_id",
            "worst.avg_score",
            "worst.bunching_pct",
            "worst.gap_pct",
            "worst.mean_dwell_sec",
        )
    )


def weekday_weekend(routes: DataFrame, segments: DataFrame) -> DataFrame:
    """Scores and dwell averaged over route days, rates as ratios of sums over stop days."""
    kind = clock.day_type(F.col("date")).alias("day_type")
    scores = routes.groupBy(kind).agg(
        F.avg("reliability_score").alias("avg_score"), F.avg("mean_dwell_sec").alias("avg_dwell")
    )
    rates = segments.groupBy(kind).agg(
        scoring.pct_of_sums("bunching_count", "total_trips").alias("bunching_pct"),
        scoring.pct_of_sums("gap_count", "total_trips").alias("gap_pct"),
    )
    return scores.join(rates, "day_type")
