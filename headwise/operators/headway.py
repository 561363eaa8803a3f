"""From pings to headways, flags and anomaly events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwise.config import DEFAULTS, ReliabilityConfig
from headwise.functions import clock
from headwise.operators import series

STOP = ["route_id", "stop_id"]

# Arrival order at a stop. Input order does not exist in Spark, so equal timestamps are settled by the other columns
# that the reliability tables depend on. Pings equal in all of these are interchangeable.
ARRIVAL_ORDER = [
    "timestamp",
    "vehicle_id",
    "stop_sequence",
    "scheduled_headway_sec",
    "dwell_sec",
    "route_base_boardings",
]
# Settles the rest where whole pings are returned.
FULL_ORDER = [*ARRIVAL_ORDER, "date", "trip_id", "latitude", "longitude"]

# What the reliability tables are computed from; trip and position columns stay in the file.
METRIC_COLUMNS = [*STOP, "date", *ARRIVAL_ORDER]

PREVIOUS = {"timestamp": "prev_timestamp", "vehicle_id": "prev_vehicle_id"}


def _lag(pings: DataFrame) -> DataFrame:
    order = [name for name in FULL_ORDER if name in pings.columns]
    arrival = Window.partitionBy(*STOP).orderBy(*order)
    return pings.withColumns({new: F.lag(old).over(arrival) for old, new in PREVIOUS.items()})


def previous_ping(pings: DataFrame, cfg: ReliabilityConfig = DEFAULTS) -> DataFrame:
    """Add time and vehicle of the ping before, at the same stop and over all dates.

    A stop with up to `split_rows` pings is sorted in one task, after one shuffle by (route, stop). Longer ones are
    sorted over as many tasks as it takes (see `series`). Which stops are long is part of the same query: a count by
    stop, combined map-side, finds at most one in `split_rows` pings; where it finds none, adaptive execution drops the
    second way before anything is read for it.
    """
    name = F.xxhash64(*STOP)  # stops that share it are only sorted the same way
    counted = pings.groupBy(name.alias("long_stop")).agg(F.count(F.lit(1)).alias("n"))
    long_stops = F.broadcast(counted.where(F.col("n") > cfg.split_rows).select("long_stop"))
    is_long = name == F.col("long_stop")
    order = [c for c in FULL_ORDER if c in pings.columns]
    short = _lag(pings.join(long_stops, is_long, "left_anti"))
    long = series.with_previous(pings.join(long_stops, is_long, "left_semi"), STOP, order, PREVIOUS)
    # Joined once more, so that without long stops all of it is known to be empty.
    return short.unionByName(long.join(long_stops, is_long, "left_semi"))


def headways(pings: DataFrame, cfg: ReliabilityConfig = DEFAULTS) -> DataFrame:
    """Minutes since the previous arrival, null when there is none or the same vehicle came again.

    A missing vehicle id equals no other, so such pings keep their headway. A repeat ping still counts as the
    predecessor of the next one.
    """
    gap = clock.wall_seconds(F.col("timestamp")) - clock.wall_seconds(F.col("prev_timestamp"))
    same_vehicle = F.col("vehicle_id") == F.col("prev_vehicle_id")
    return (
        previous_ping(pings, cfg)
        .withColumn("headway_sec", F.when(same_vehicle, None).otherwise(gap))
        .withColumns(
            {
                "headway_min": F.col("headway_sec") / F.lit(60.0),
                "scheduled_headway_min": F.col("scheduled_headway_sec") / F.lit(60.0),
            }
        )
        .drop(*PREVIOUS.values())
    )


def flag_anomalies(headway_table: DataFrame, cfg: ReliabilityConfig = DEFAULTS) -> DataFrame:
    """Keep the valid headways and flag bunching and gaps, both strict comparisons."""

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    actual, scheduled = F.col("headway_min"), F.col("scheduled_headway_min")
    return headway_table.where(actual.isNotNull()).withColumns(
        {
            "is_bunching": flag(actual < scheduled * cfg.bunching_threshold),
            "is_gap": flag(actual > scheduled * cfg.gap_threshold),
        }
    )


def flagged_headways(pings: DataFrame, cfg: ReliabilityConfig = DEFAULTS) -> DataFrame:
    """Flagged valid headways with only the columns that the reliability tables need."""
    flagged = flag_anomalies(headways(pings.select(METRIC_COLUMNS), cfg), cfg)
    return flagged.drop("headway_sec", "scheduled_headway_sec")


def anomaly_events(flagged: DataFrame) -> DataFrame:
    return flagged.where(F.col("is_bunching") | F.col("is_gap")).select(
        "timestamp",
        "vehicle_id",
        "route_id",
        "stop_id",
        "stop_sequence",
        "headway_min",
        "scheduled_headway_min",
        "is_bunching",
        "is_gap",
        F.when(F.col("is_bunching"), "bunching").otherwise("gap").alias("anomaly_type"),
        F.substring(F.col("timestamp").cast("string"), 1, 19).alias("timestamp_str"),
    )
