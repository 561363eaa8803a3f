"""The row before, in series of any length.

A window over a series sorts it whole in one task, which a hot stop makes as large as the data. Here rows are sorted by
range partitions of (series, order) instead: any number of tasks shares a series, and one with copies of a single row
is the most that can't be split. Inside a partition the row before is the one before in the sort. A partition's first
row gets the last row of the partition before it, through a table with a row for each partition.

Partitions are bounded by what Spark samples from the data. Both the sorted rows and the table of edges read the same
shuffle; should a plan ever shuffle twice, with other bounds, the query fails rather than give wrong rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _shift(kinds: T.StructType, n_series: int):
    """The values of the row before, null where another series begins, and whether a row is its partition's first."""
    names = [*kinds.names, "opens"]
    result = T.StructType([*kinds.fields, T.StructField("opens", T.BooleanType())])

    # Nothing of this package is used inside, so executors need not have it.
    def shifted(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        import pyarrow as pa
        import pyarrow.compute as pc

        last: list[pa.Array] = []
        for columns in batches:
            n = len(columns[0])
            opens = pa.array([i == 0 and not last for i in range(n)], pa.bool_())
            head = last or [pa.nulls(min(n, 1), c.type) for c in columns]
            before = [pa.concat_arrays([h, c.slice(0, max(n - 1, 0))]) if n else c for h, c in zip(head, columns, strict=True)]
            same = pa.array([True] * n, pa.bool_())
            for now, then in zip(columns[:n_series], before[:n_series], strict=True):
                both_null = pc.and_(pc.is_null(now), pc.is_null(then))
                same = pc.and_(same, pc.or_(pc.fill_null(pc.equal(now, then), False), both_null))
            if n and not last:
                same = pc.and_(same, pc.invert(opens))
            if n:
                last = [c.slice(n - 1, 1) for c in columns]
            values = [pc.if_else(same, c, pa.scalar(None, c.type)) for c in before[n_series:]]
            yield pa.StructArray.from_arrays([*values, opens], names)

    shifted.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(shifted, result).asNondeterministic()  # filters stay above it


def with_previous(
    rows: DataFrame, series: Sequence[str], order: Sequence[str], carried: dict[str, str], partitions: int | None = None
) -> DataFrame:
    """Add columns of the row before in the same series: `carried` names the new column of each old one.

    Rows of a series are ordered by `order`, then by all other columns; rows that are equal in everything follow one
    another. Nulls come first, and a null in a series column is a series like any other. All columns must be orderable.
    An empty table gives an empty one.
    """
    spark = rows.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [*series, *order, *(c for c in rows.columns if c not in {*series, *order})]
    everything = F.struct(*names)
    # As many partitions as asked for, so that both readers of the shuffle number them alike.
    ranged = rows.select(*names).repartitionByRange(partitions, *names)
    part = F.spark_partition_id().alias("_part")
    edges = ranged.groupBy(part).agg(F.min(everything).alias("first"), F.max(everything).alias("last"))
    handed = F.lag("last").over(Window.orderBy("_part"))  # a row for each partition
    edges = edges.select("_part", F.col("first").alias("_first"), handed.alias("_handed"))
    kinds = T.StructType([T.StructField(new, rows.schema[old].dataType) for old, new in carried.items()])
    before = _shift(kinds, len(series))(*series, *carried)
    sorted_ = ranged.sortWithinPartitions(*names).select(*names, part, before.alias("_before"))

    def same_series() -> Column:
        matches = [F.col(c).eqNullSafe(F.col(f"_handed.{c}")) for c in series]
        both = matches[0]
        for m in matches[1:]:
            both = both & m
        return both & F.col("_handed").isNotNull()

    known = F.when(everything.eqNullSafe(F.col("_first")), True).otherwise(
        F.raise_error(F.lit("a series was shuffled twice with other bounds; its rows can't be handed on"))
    )

    def previous(old: str, new: str) -> Column:
        opening = F.when(known & same_series(), F.col(f"_handed.{old}"))
        return F.when(F.col("_before.opens"), opening).otherwise(F.col(f"_before.{new}"))

    joined = sorted_.join(F.broadcast(edges), "_part", "left")
    return joined.select(*rows.columns, *[previous(old, new).alias(new) for old, new in carried.items()])
