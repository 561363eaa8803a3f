"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
    "STRING": T.StringType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
}


def _schema(spec: str) -> T.StructType:
    """From "name TYPE, ..." without needing a running session."""
    fields = [part.split() for part in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


PINGS = _schema(
    "timestamp TIMESTAMP_NTZ, vehicle_id STRING, route_id STRING, stop_id STRING, stop_sequence INT, "
    "latitude DOUBLE, longitude DOUBLE, trip_id STRING, scheduled_headway_sec BIGINT, dwell_sec BIGINT, "
    "route_base_boardings BIGINT, date STRING"
)

SEGMENTS = _schema(
    "route_id STRING, stop_id STRING, date STRING, total_trips BIGINT, mean_headway DOUBLE, std_headway DOUBLE, "
    "bunching_count BIGINT, gap_count BIGINT, mean_dwell_sec DOUBLE, route_base_boardings BIGINT, "
    "headway_cov DOUBLE, bunching_rate DOUBLE, gap_rate DOUBLE, reliability_score DOUBLE"
)

ROUTES = _schema(
    "route_id STRING, date STRING, reliability_score DOUBLE, mean_headway DOUBLE, bunching_count BIGINT, "
    "gap_count BIGINT, mean_dwell_sec DOUBLE, route_base_boardings BIGINT, prev_week_score DOUBLE, wow_trend DOUBLE"
)

ANOMALIES = _schema(
    "timestamp TIMESTAMP_NTZ, vehicle_id STRING, route_id STRING, stop_id STRING, stop_sequence INT, "
    "headway_min DOUBLE, scheduled_headway_min DOUBLE, is_bunching BOOLEAN, is_gap BOOLEAN, "
    "anomaly_type STRING, timestamp_str STRING"
)

#: Stored beside the published columns of a stop's day: sums that give the mean schedule of any group of stop days.
SCHEDULE = _schema("scheduled_min_sum DOUBLE, scheduled_trips BIGINT")

#: The partition column of the published events.
EVENT_DATE = "event_date"


def string(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())
