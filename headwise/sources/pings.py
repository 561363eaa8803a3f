"""Reading and shaping pings: one row per vehicle arrival at a stop."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwise import schema
from headwise.functions import clock


def read_pings(spark: SparkSession, *paths: str) -> DataFrame:
    """Scan one or more Parquet directories, date-partitioned or flat."""
    return normalize_pings(spark.read.parquet(*paths))


def for_counting(spark: SparkSession, *paths: str) -> DataFrame:
    """The rows of Parquet files for COUNT(*), and for minima and maxima, which Spark then takes from the files' footers.

    Only Spark's second reader can do so. Where a query asks for more than counts, the same DataFrame is scanned.
    """
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    first_readers = spark.conf.get("spark.sql.sources.useV1SourceList")
    spark.conf.set("spark.sql.sources.useV1SourceList", ",".join(x for x in first_readers.split(",") if x.strip() != "parquet"))
    try:
        return spark.read.parquet(*paths)
    finally:
        spark.conf.set("spark.sql.sources.useV1SourceList", first_readers)


def normalize_pings(pings: DataFrame) -> DataFrame:
    """Cast to the ping schema, fill in a missing date, and drop rows that belong to no stop series.

    A ping without route, stop or time can neither get nor give a headway, and the aggregates have no group for it.
    """
    if "date" not in pings.columns:
        pings = pings.withColumn("date", clock.date_string(F.col("timestamp")))
    typed = [f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in schema.PINGS]
    return pings.selectExpr(typed).where("route_id IS NOT NULL AND stop_id IS NOT NULL AND timestamp IS NOT NULL")


def pings_for_day(pings: DataFrame, date: str) -> DataFrame:
    """One date; on a date-partitioned directory this reads only that partition."""
    return pings.where(F.col("date") == date)


def within_day_bounds(pings: DataFrame) -> DataFrame:
    """Drop pings whose clock ran past the day they are filed under."""
    return pings.where(clock.date_string(F.col("timestamp")) == F.col("date"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def write_pings(pings: DataFrame, path: str) -> None:
    """Date-partitioned, snappy Parquet sink.

    REBALANCE lets adaptive execution split a heavy date over several files and gather small ones.
    """
    (
        pings.hint("rebalance", F.col("date"))
        .write.mode("overwrite")
        .option("compression", "snappy")
        .partitionBy("date")
        .parquet(path)
    )
