"""Wall-clock arithmetic. Everything here reads the local clock fields of a timestamp, so results for
TIMESTAMP_NTZ do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SEC = 86400


def wall_seconds(ts: Column) -> Column:
    """Whole seconds since 1970-01-01 00:00, rounded down."""
    # unix_timestamp is the fast way, but rounds up before 1970.
    by_fields = F.unix_date(F.to_date(ts)).cast("bigint") * DAY_SEC + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    since_1970 = ts >= F.lit("1970-01-01").cast("timestamp_ntz")
    return F.when(since_1970, F.unix_timestamp(ts)).otherwise(by_fields)


def day_number(ts: Column) -> Column:
    """Days since 1970-01-01."""
    return F.floor(wall_seconds(ts) / F.lit(DAY_SEC))


def minute_number(ts: Column) -> Column:
    """Minutes since 1970-01-01 00:00."""
    return F.floor(wall_seconds(ts) / F.lit(60))


def seconds_between(earlier: str, later: str) -> Column:
    """Difference of two timestamp columns, exact to the microsecond."""
    return F.expr(f"CAST(CAST(CAST({later} - {earlier} AS INTERVAL SECOND) AS DECIMAL(18, 6)) AS DOUBLE)")


def date_string(ts: Column) -> Column:
    return F.to_date(ts).cast("string")


def hour_fraction(ts: Column) -> Column:
    return F.pmod(wall_seconds(ts), F.lit(DAY_SEC)) / F.lit(3600.0)


def is_peak(hour: Column) -> Column:
    # Morning and evening peak, both ends included.
    return hour.between(8.0, 10.0) | hour.between(17.0, 19.0)


def is_weekend(date: Column) -> Column:
    return F.dayofweek(F.to_date(date)).isin(1, 7)


def day_type(date: Column) -> Column:
    return F.when(is_weekend(date), "Weekend").otherwise("Weekday")
