"""Exact interpolated percentiles by distributed selection.

Equal values are counted once. The counted values are sorted into range partitions, and one count over each partition
proves in which of them a wanted rank lies and how many values are below; only these partitions are then looked into, by
a task for each rank. The bounds of the ranges come from a sample, but no result depends on them: uneven ranges cost
time, never exactness. All ranks take part in the same two reads of one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Times the counted values are read, whatever the number of ranks.
READS = 2


def percentiles(
    df: DataFrame, column: str, probabilities: Sequence[float], partitions: int | None = None
) -> DataFrame:
    """A row (probability, value) for each probability: the value at rank (n - 1) * probability.

    Between two ranks it is interpolated. Nulls and NaN are no values; without any value all results are null.
    """
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = F.col("v")
    values = df.select(F.col(column).cast("double").alias("v")).where(v.isNotNull() & ~F.isnan("v"))
    values = values.groupBy(F.when(v == 0, 0.0).otherwise(v).alias("v")).agg(F.count(F.lit(1)).alias("copies"))
    # As many partitions as asked for, so that both readers of the shuffle number them alike.
    ranged = values.repartitionByRange(partitions, "v")
    part = F.spark_partition_id().alias("part")

    # A row for each partition.
    counted = ranged.groupBy(part).agg(F.sum("copies").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    upto = F.sum("n").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, 0))
    before = F.lag("high").over(Window.orderBy("low"))
    counted = counted.select("*", upto.alias("upto"), before.alias("before"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("all"))
    wanted = []
    for i, p in enumerate(probabilities):
        exact = (F.col("all") - 1) * F.lit(float(p))
        for k, rank in enumerate((F.floor(exact), F.ceil(exact))):
            wanted.append(F.struct(F.lit(2 * i + k).alias("id"), rank.alias("rank"), (exact - F.floor(exact)).alias("weight")))
    below = F.col("upto") - F.col("n")
    here = F.filter(F.array(*wanted), lambda w: (w["rank"] < F.col("upto")) & (w["rank"] >= below))
    apart = F.col("before").isNull() | (F.col("before") < F.col("low"))
    state = counted.select("part", "n", "low", "high", apart.alias("apart"), below.alias("below"), F.explode(here).alias("w"))
    state = state.select("part", "n", "low", "high", "apart", "w.id", "w.weight", (F.col("w.rank") - F.col("below")).alias("rank"))

    # A row for each wanted rank is broadcast.
    near = ranged.select("v", "copies", part).join(F.broadcast(state), "part")
    near = near.withColumn(
        "upto", F.sum("copies").over(Window.partitionBy("id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    )
    at_rank = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("copies"))
    picked = near.groupBy("id", "weight", "n", "low", "high", "apart").agg(
        F.max(F.when(at_rank, v)).alias("v"),
        F.sum("copies").alias("found"), F.min("v").alias("least"), F.max("v").alias("most"),
    )
    # What was counted is what was looked into, and ranges don't overlap.
    proved = F.col("apart") & (F.col("found") == F.col("n")) & (F.col("least") == F.col("low")) & (F.col("most") == F.col("high"))
    fail = F.raise_error(F.lit("the values were shuffled twice with other bounds; no rank is proved"))
    picked = picked.select("id", "weight", F.when(proved, v).otherwise(fail).alias("v"))

    def at(i: int, name: str) -> Column:
        return F.max(F.when(F.col("id") == i, F.col(name)))

    rows = []
    for i, p in enumerate(probabilities):
        low, high = at(2 * i, "v"), at(2 * i + 1, "v")
        value = F.when(low == high, low).otherwise(low + (high - low) * at(2 * i, "weight"))
        rows.append(F.struct(F.lit(float(p)).alias("probability"), value.alias("value")))
    return picked.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def percentile(df: DataFrame, column: str, probability: float) -> DataFrame:
    """One row (probability, value)."""
    return percentiles(df, column, [probability])


def median(df: DataFrame, column: str) -> DataFrame:
    return percentile(df, column, 0.5).select("value")
