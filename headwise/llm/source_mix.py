"""Mixing sources to target weights: each source's documents are repeated at the rate that brings it to its target.

One pass counts words per source. Targets share a budget by weight; what a source can't take (more than `MOST` times its
size) goes to the others by weight, until none is above. That has a closed form over the sources in the order of size
per weight, so nothing is iterated. A document is taken floor(rate) times, and once more if its hash, as a number in
[0, 1), is below the fraction of the rate: no exchange of documents, and the same mix in every run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwise.llm import storage

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix for each word of the input, and the most that a source may be repeated.
SHARE, MOST = 1.5, 2.0
SEED = "mix-1"


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the hash of key and seed, with 52 bits."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Target of every source: source, source_size, target; from (source, size) of documents.

    The plan is made over one row for each source, so it is the number of sources that has to fit a task.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights)) + 1)
    ranked = sources.withColumn("weight", weight).withColumn("full", most * F.col("source_size"))
    filled = Window.orderBy(F.col("full") / F.col("weight"), F.asc_nulls_last("source"))
    before, every = filled.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # With all earlier sources full, this one gets `level` for each unit of weight. The first that isn't full then sets
    # it; the levels of later ones are lower, since they count sources as full that aren't.
    ranked = ranked.withColumn("level", left / heavy)
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("full"), F.col("level"))).over(every)
    target = F.least("full", F.coalesce(level * F.col("weight"), "full"))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(documents: DataFrame, key: str = "doc_id", **plan) -> DataFrame:
    """Every document with how often the mix takes it: all its columns, size, source_size, target and copies.

    size is the number of words (separated by ASCII white space; null: 0). A null source is a source. A source without
    words has the target 0 and its documents are taken once, since they cost nothing. Rows that share a doc_id share the
    draw. An empty table gives an empty table. A column of the input that has one of the new names is replaced.
    """
    new = ("size", "source_size", "target", "copies")
    sized = documents.drop(*new).withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    name = storage.unused(documents, "_source")
    plans = targets(sized.select("source", "size"), **plan).withColumnRenamed("source", name)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0)
    extra = draw(F.col(key), SEED) < rate - F.floor(rate)
    mixed = sized.join(plans, F.col("source").eqNullSafe(F.col(name))).drop(name)
    return mixed.withColumn("copies", (F.floor(rate) + extra.cast("int")).cast("long"))


def emit(documents: DataFrame, **plan) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with the columns it came with."""
    # Columns that mix() would replace come back as they were.
    names = {c: storage.unused(documents, f"_{c}") for c in ("size", "source_size", "target", "copies") if c in documents.columns}
    mixed = mix(documents.withColumnsRenamed(names), **plan)
    name = storage.unused(mixed, "_copy")
    times = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias(name)
    return mixed.select(*[F.col(names.get(c, c)).alias(c) for c in documents.columns], times).drop(name)


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS weight,
    2.0::DOUBLE * source_size AS "full" FROM sources),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
      - coalesce(sum("full") OVER (ORDER BY "full" / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER ()
      - coalesce(sum(weight) OVER (ORDER BY "full" / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM ranked),
targets AS (
  SELECT source, source_size,
    least("full", coalesce(max(CASE WHEN level * weight <= "full" THEN level END) OVER () * weight, "full")) AS target
  FROM levels),
rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0 END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN
    CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE
    < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM rated
"""
