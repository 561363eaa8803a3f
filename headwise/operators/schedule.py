"""Service days, peak bands and stop spacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwise.functions import clock


def service_days(pings: DataFrame, first: str | None = None) -> DataFrame:
    """The calendar days from `first` (or the earliest date) to the latest with their number of pings, 0 without any."""
    counted = pings.where(F.col("date").isNotNull()).groupBy("date").agg(F.count(F.lit(1)).alias("pings"))
    begin = F.to_date(F.min("date")) if first is None else F.to_date(F.lit(first))
    calendar = counted.agg(F.sequence(begin, F.to_date(F.max("date"))).cast("array<string>").alias("days"))
    calendar = calendar.select(F.explode("days").alias("date"))
    return calendar.join(counted, "date", "left").select("date", F.coalesce("pings", F.lit(0)).alias("pings"))


def peak_flags(pings: DataFrame) -> DataFrame:
    """Hour of day as a fraction, and whether it falls in a peak band."""
    return pings.withColumn("hour", clock.hour_fraction(F.col("timestamp"))).withColumn(
        "is_peak", clock.is_peak(F.col("hour"))
    )


def stop_spacing(pings: DataFrame) -> DataFrame:
    """Planar distance in degrees from each stop to the one before it on its route; 0 at the first stop.

    Pings are reduced to one mean position per stop first, so only the stop list is ordered.
    """
    stops = pings.groupBy("route_id", "stop_id", "stop_sequence").agg(
        F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude")
    )
    along = Window.partitionBy("route_id").orderBy("stop_sequence", "stop_id")

    def step(axis: str) -> Column:
        return F.col(axis) - F.lag(axis).over(along)

    return stops.withColumn(
        "spacing", F.coalesce(F.hypot(step("latitude"), step("longitude")), F.lit(0.0))
    )
