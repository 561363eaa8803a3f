"""Published tables: layout, views, catalog loads, and the stored answers."""

from __future__ import annotations

import logging
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwise import schema
from headwise.functions import clock
from headwise.sources import snapshots

ROUTE_SCORES = "route_scores"
SEGMENT_METRICS = "daily_segment_metrics"
ANOMALY_EVENTS = "anomaly_events"
OUTPUT_TABLES = {
    ROUTE_SCORES: schema.ROUTES,
    SEGMENT_METRICS: schema.SEGMENTS,
    ANOMALY_EVENTS: schema.ANOMALIES,
}
ANSWERS = "answers"
QUALITY_CHECKS = "quality_checks"
#: Large, and mostly read for their latest dates. Events have no date column, so they get one of their own.
PARTITIONS = {SEGMENT_METRICS: "date", ANOMALY_EVENTS: schema.EVENT_DATE}
#: Columns that are stored and that views and the catalog don't show.
STORED_ONLY = {SEGMENT_METRICS: schema.SCHEDULE.fields, ANOMALY_EVENTS: [schema.string(schema.EVENT_DATE)]}

log = logging.getLogger(__name__)


def _stored(table: str) -> T.StructType:
    return T.StructType([*OUTPUT_TABLES[table].fields, *STORED_ONLY.get(table, [])])


def write_table(df: DataFrame, path: str, table: str) -> DataFrame:
    """Write one table in its layout and read it back.

    Rebalancing gives files of a sensible size and lets adaptive execution split a heavy date over several.
    """
    partition = PARTITIONS.get(table)
    if table == ANOMALY_EVENTS:
        df = df.withColumn(partition, clock.date_string(F.col("timestamp")))
    df = df.select(_stored(table).names)
    if partition:
        df.hint("rebalance", F.col(partition)).write.partitionBy(partition).parquet(path)
    else:
        df.hint("rebalance").write.parquet(path)
    return _read(df.sparkSession, path, table)


def _read(spark: SparkSession, path: str, table: str) -> DataFrame:
    kinds = _stored(table)
    return spark.read.schema(kinds).parquet(path).select(kinds.names)


def read_table(spark: SparkSession, output_dir: str, table: str) -> DataFrame | None:
    """The table of the newest published run, or None (with a warning) where there is none."""
    path = snapshots.current(spark, output_dir).get(table)
    if path is None:
        log.warning("no table %s published in %s, skipped", table, output_dir)
        return None
    return _read(spark, path, table).drop(*schema.SCHEDULE.names)


def register_views(spark: SparkSession, output_dir: str) -> list[str]:
    """Temp views over whatever is published, all of one run; returns the names registered."""
    paths = snapshots.current(spark, output_dir)
    found = [name for name in OUTPUT_TABLES if name in paths]
    for name in found:
        _read(spark, paths[name], name).select(OUTPUT_TABLES[name].names).createOrReplaceTempView(name)
    return found


def load_catalog(spark: SparkSession, output_dir: str, database: str) -> list[str]:
    """Replace the tables of a catalog database by the published ones, all or none; returns the names loaded.

    Rows are loaded into tables with new names first. When all are there, views with the tables' names are switched to
    them and the tables they showed before are dropped. Raises, with nothing changed, if a table is missing.
    """
    paths = snapshots.current(spark, output_dir)
    missing = [name for name in OUTPUT_TABLES if name not in paths]
    if missing:
        raise FileNotFoundError(f"not published in {output_dir}: {', '.join(missing)}")
    load = uuid.uuid4().hex[:12]
    new = {name: f"`{database}`.`{name}__{load}`" for name in OUTPUT_TABLES}
    try:
        for name, table in new.items():
            _read(spark, paths[name], name).select(OUTPUT_TABLES[name].names).write.saveAsTable(table)
    except Exception:
        for table in new.values():
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        raise
    for name, table in new.items():
        spark.sql(f"CREATE OR REPLACE VIEW `{database}`.`{name}` AS SELECT * FROM {table}")
    for row in spark.sql(f"SHOW TABLES IN `{database}`").collect():
        name, _, of = row.tableName.partition("__")
        if name in OUTPUT_TABLES and of and of != load:
            spark.sql(f"DROP TABLE `{database}`.`{row.tableName}`")
    return list(OUTPUT_TABLES)


def read_foreign(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table that another program wrote, in our schema: columns cast, missing ones null, NaN as null."""
    found = spark.read.parquet(path)

    def column(field: T.StructField) -> Column:
        value = F.col(field.name) if field.name in found.columns else F.lit(None)
        value = value.cast(field.dataType)
        if isinstance(field.dataType, T.DoubleType):
            value = F.when(~F.isnan(value), value)
        return value.alias(field.name)

    return found.select(*[column(field) for field in OUTPUT_TABLES[table]])


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Stored answers as (question, answer), from JSON lines or a single JSON array of objects.

    Where there is no file, the result is empty. A record that is no JSON object of this schema, or has no question or
    no answer, is left out with a warning in the log; unknown fields are ignored.
    """
    kinds = "question string, answer string, _corrupt_record string"
    try:
        records = spark.read.schema(kinds).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        log.warning("no answers at %s", path)
        return spark.createDataFrame([], "question string, answer string")
    good = F.col("_corrupt_record").isNull() & F.col("question").isNotNull() & F.col("answer").isNotNull()
    return records.where(good).select("question", "answer")
