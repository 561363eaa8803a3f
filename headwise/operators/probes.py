"""Fixed-threshold statistics and single-route probes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwise.config import DEFAULTS, ReliabilityConfig
from headwise.functions import clock
from headwise.operators import headway

# Fixed values of the simple variant, in minutes.
BUNCHED_BELOW_MIN = 2.0
GAP_ABOVE_MIN = 20.0


def route_stats_fixed(pings: DataFrame, cfg: ReliabilityConfig = DEFAULTS) -> DataFrame:
    """Route statistics over plain arrival differences: no vehicle rule, fixed thresholds, exact to the microsecond."""
    arrivals = headway.previous_ping(pings.select(*headway.STOP, *headway.ARRIVAL_ORDER), cfg)
    minutes = F.col("headway_min")
    return (
        arrivals.where(F.col("prev_timestamp").isNotNull())
        .withColumn("headway_min", clock.seconds_between("prev_timestamp", "timestamp") / F.lit(60.0))
        .groupBy("route_id")
        .agg(
            F.avg(minutes).alias("mean_headway"),
            F.stddev_samp(minutes).alias("std_headway"),
            F.avg((minutes < BUNCHED_BELOW_MIN).cast("int")).alias("bunching_rate"),
            F.avg((minutes > GAP_ABOVE_MIN).cast("int")).alias("gap_rate"),
        )
    )


def route_headways(pings: DataFrame, route_id: str, cfg: ReliabilityConfig = DEFAULTS) -> DataFrame:
    """One route's arrivals with plain headways, the vehicle rule left out. Filter to a date first to probe a day."""
    one_route = pings.where(F.col("route_id") == route_id).select(*headway.STOP, *headway.ARRIVAL_ORDER)
    gap = clock.wall_seconds(F.col("timestamp")) - clock.wall_seconds(F.col("prev_timestamp"))
    return headway.previous_ping(one_route, cfg).select(
        "timestamp", "stop_id", "vehicle_id", gap.alias("headway_sec")
    )


def headway_histogram(probe: DataFrame, limit: int = 10) -> DataFrame:
    """The most frequent headways."""
    return (
        probe.where(F.col("headway_sec").isNotNull())
        .groupBy("headway_sec")
        .agg(F.count(F.lit(1)).alias("pings"))
        .orderBy(F.desc("pings"), "headway_sec")
        .limit(limit)
    )
