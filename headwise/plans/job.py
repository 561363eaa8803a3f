"""The batch job: pings in, checked tables and reports out, published as one snapshot."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwise.config import DEFAULTS, ReliabilityConfig
from headwise.operators import headway, metrics, quality
from headwise.plans import decisions, reports
from headwise.sources import pings as ping_source
from headwise.sources import snapshots, tables


class QualityError(RuntimeError):
    """The tables failed their checks and were not published."""

    def __init__(self, failed: list[str]):
        super().__init__("failed checks: " + ", ".join(failed))
        self.failed = failed


def run(
    spark: SparkSession,
    pings: DataFrame,
    output_dir: str,
    cfg: ReliabilityConfig = DEFAULTS,
    publish_failed: bool = False,
) -> dict[str, float]:
    """Compute, check, publish; returns the seconds each stage took.

    Everything is written once, into a folder of this run: flagged headways, which metrics and anomaly events both read
    and which are removed in the end, then the tables, each made from the one before as written, so later steps neither
    recompute it nor depend on the executors that made it. Checks run on the written tables; only then they are
    published, together. A run that fails leaves what was published before, and nothing of its own.
    """
    seconds: dict[str, float] = {}

    @contextmanager
    def stage(name: str) -> Iterator[None]:
        start = time.perf_counter()
        yield
        seconds[name] = time.perf_counter() - start

    own = snapshots.begin(spark, output_dir)
    try:
        with stage("load"):
            pings = pings.select(headway.METRIC_COLUMNS)
        with stage("groupby_headway"):
            flagged = headway.flagged_headways(pings, cfg)
            flagged.write.parquet(own.path("flagged"))
            flagged = spark.read.schema(flagged.schema).parquet(own.path("flagged"))
        with stage("scoring"):
            segments = metrics.segment_metrics(flagged, cfg)
            segments = tables.write_table(segments, own.path(tables.SEGMENT_METRICS), tables.SEGMENT_METRICS)
            routes = metrics.route_scores(segments, cfg)
            routes = tables.write_table(routes, own.path(tables.ROUTE_SCORES), tables.ROUTE_SCORES)
        with stage("validate"):
            checks = quality.quality_checks(routes, segments)
            report = checks.collect()  # one row per check
            failed = [row.check for row in report if not row.passed]
            if failed and not publish_failed:
                raise QualityError(failed)
        with stage("save"):
            events = headway.anomaly_events(flagged)
            tables.write_table(events, own.path(tables.ANOMALY_EVENTS), tables.ANOMALY_EVENTS)
            tables.write_json(spark.createDataFrame(report, checks.schema), own.path(tables.QUALITY_CHECKS))
            own.drop("flagged")
            snapshots.publish(own, [*tables.OUTPUT_TABLES, tables.QUALITY_CHECKS])
    except BaseException:
        own.discard()
        raise
    return seconds


def run_from_paths(
    spark: SparkSession, input_dir: str, output_dir: str, cfg: ReliabilityConfig = DEFAULTS, publish_failed: bool = False
) -> dict[str, float]:
    return run(spark, ping_source.read_pings(spark, input_dir), output_dir, cfg, publish_failed)


def published(spark: SparkSession, output_dir: str) -> tuple[DataFrame, DataFrame]:
    """Route scores and segment metrics of the newest run."""
    paths = snapshots.current(spark, output_dir)
    if not {tables.ROUTE_SCORES, tables.SEGMENT_METRICS} <= set(paths):
        raise FileNotFoundError(f"nothing published in {output_dir}")
    return tuple(tables._read(spark, paths[name], name) for name in (tables.ROUTE_SCORES, tables.SEGMENT_METRICS))


def write_reports(
    spark: SparkSession, input_dir: str | None, output_dir: str, cfg: ReliabilityConfig = DEFAULTS
) -> str:
    """Answers to the report questions, from the published tables, as JSON next to them; returns their path.

    With an input directory, the schedules told are means over all its pings instead of those the tables keep.
    """
    routes, segments = published(spark, output_dir)
    pings = None if input_dir is None else ping_source.read_pings(spark, input_dir)
    answers = reports.answers(routes, segments, pings, cfg=cfg)
    path = f"{output_dir.rstrip('/')}/{tables.ANSWERS}"
    tables.write_json(answers, path)
    return path


def reconcile(spark: SparkSession, output_dir: str) -> DataFrame:
    """The stored answers against the published tables."""
    routes, segments = published(spark, output_dir)
    stored = tables.read_answers(spark, f"{output_dir.rstrip('/')}/{tables.ANSWERS}")
    return reports.reconcile(stored, routes, segments)


def check(spark: SparkSession, output_dir: str, cfg: ReliabilityConfig = DEFAULTS) -> DataFrame:
    """All checks of the published tables, and whether they give every decision card: check, value, passed."""
    routes, segments = published(spark, output_dir)
    n = F.count(F.lit(1))
    cards = decisions.decision_cards(segments, routes, cfg).agg(
        F.lit("decision_cards").alias("check"), n.cast("double").alias("value"), (n == cfg.n_cards).alias("passed")
    )
    return quality.all_checks(routes, segments).unionByName(cards)
