"""Joins of rows with a table of their groups, where one group may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups with more than one in so many of all rows are broadcast; by that there are fewer than so many of them.
HOT = 1000


def with_groups(rows: DataFrame, groups: DataFrame, key: str, place: list[str]) -> DataFrame:
    """Rows that have a group, with its columns as `group`; groups have the key, once, and their number of rows, n.

    The rows of a broadcast group are dealt over all tasks by the columns `place`, which tell them apart.
    """
    held = F.struct(*[c for c in groups.columns if c != key])
    hot = groups.where(F.col("n") * HOT > groups.agg(F.sum("n")).scalar()).select(key, held.alias("hot"))
    even = F.coalesce(F.when(F.col("hot").isNotNull(), F.xxhash64(*place)), F.lit(0))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("dealt", even)
    others = groups.select(key, held.alias("other"), F.lit(0).cast("long").alias("dealt"))
    found = dealt.join(others, [key, "dealt"], "left").withColumn("group", F.coalesce("hot", "other"))
    return found.where("group is not null").select(*rows.columns, "group")
