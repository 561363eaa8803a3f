"""The batch job, its sinks and its sources."""

from __future__ import annotations

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import ROOT
from headwise import schema
from headwise.operators import headway, metrics, schedule
from headwise.plans import job, reports, serving
from headwise.sources import pings as ping_source
from headwise.sources import snapshots, tables

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def network(spark):
    return entry.Network(spark, SF_DIR)


@pytest.fixture(scope="module")
def ping_dir(network, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("data") / "pings")
    ping_source.write_pings(network.pings, path)
    return path


@pytest.fixture(scope="module")
def output_dir(spark, ping_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("data") / "out")
    seconds = job.run_from_paths(spark, ping_dir, path, publish_failed=True)
    assert list(seconds) == ["load", "groupby_headway", "scoring", "validate", "save"]
    return path


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_pings_survive_the_partitioned_sink(spark, network, ping_dir):
    back = ping_source.read_pings(spark, ping_dir)
    assert back.schema.names == schema.PINGS.names
    assert [f.dataType for f in back.schema] == [f.dataType for f in schema.PINGS]
    assert rows(back) == rows(network.pings)


def test_day_filter_prunes_partitions(spark, ping_dir):
    day = ping_source.pings_for_day(ping_source.read_pings(spark, ping_dir), "2024-01-03")
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2024-01-03" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.date for r in day.select("date").distinct().collect()} == {"2024-01-03"}


def test_many_paths_read_as_one(spark, ping_dir):
    days = [f"{ping_dir}/date=2024-01-0{d}" for d in (1, 2, 3)]
    whole = ping_source.read_pings(spark, ping_dir).where(F.col("date") <= "2024-01-03")
    assert rows(ping_source.read_pings(spark, *days)) == rows(whole)


def test_published_tables_equal_the_operators(spark, network, output_dir):
    assert rows(tables.read_table(spark, output_dir, tables.SEGMENT_METRICS)) == rows(
        network.segments.select(schema.SEGMENTS.names))
    assert rows(tables.read_table(spark, output_dir, tables.ROUTE_SCORES)) == rows(
        network.routes.select(schema.ROUTES.names))
    events = tables.read_table(spark, output_dir, tables.ANOMALY_EVENTS)
    assert rows(events.select(schema.ANOMALIES.names)) == rows(network.events)
    assert events.where("event_date != left(timestamp_str, 10)").count() == 0


def test_property_invariants(network):
    segments = network.segments.cache()
    valid = network.flagged.count()
    assert segments.agg(F.sum("total_trips")).first()[0] == valid
    assert segments.where(~F.col("reliability_score").between(0, 100)).count() == 0
    flags = segments.agg(F.sum("bunching_count") + F.sum("gap_count")).first()[0]
    assert network.events.count() == flags  # no headway has both flags
    assert segments.select("route_id", "stop_id", "date").distinct().count() == segments.count()
    segments.unpersist()


def test_views_and_catalog(spark, output_dir, tmp_path):
    assert tables.register_views(spark, output_dir) == list(tables.OUTPUT_TABLES)
    n = spark.sql("SELECT count(*) AS n FROM route_scores WHERE date = (SELECT max(date) FROM route_scores)").first().n
    assert n > 0
    spark.sql(f"CREATE DATABASE IF NOT EXISTS headwise_test LOCATION '{tmp_path}/db'")
    try:
        for _ in range(2):  # loading again replaces
            assert tables.load_catalog(spark, output_dir, "headwise_test") == list(tables.OUTPUT_TABLES)
        assert spark.table("headwise_test.route_scores").count() == tables.read_table(
            spark, output_dir, tables.ROUTE_SCORES).count()
    finally:
        spark.sql("DROP DATABASE headwise_test CASCADE")


def test_missing_tables_are_skipped(spark, tmp_path):
    assert tables.register_views(spark, str(tmp_path)) == []
    assert tables.read_table(spark, str(tmp_path), tables.ROUTE_SCORES) is None
    with pytest.raises(FileNotFoundError, match="route_scores"):
        tables.load_catalog(spark, str(tmp_path), "default")


def test_failed_checks_stop_publication(spark, ping_dir, tmp_path):
    with pytest.raises(job.QualityError) as error:
        job.run_from_paths(spark, ping_dir, str(tmp_path))
    assert "median_headway_min" in error.value.failed
    assert tables.read_table(spark, str(tmp_path), tables.ROUTE_SCORES) is None
    assert not list(tmp_path.glob("runs/*"))


def test_a_failure_between_tables_publishes_none(spark, ping_dir, output_dir, monkeypatch):
    before = snapshots.current(spark, output_dir)
    write = tables.write_table

    def broken(df, path, table):
        if table == tables.ANOMALY_EVENTS:
            raise OSError("disk full")
        return write(df, path, table)

    monkeypatch.setattr(tables, "write_table", broken)
    with pytest.raises(OSError, match="disk full"):
        job.run_from_paths(spark, ping_dir, output_dir, publish_failed=True)
    assert snapshots.current(spark, output_dir) == before
    assert tables.read_table(spark, output_dir, tables.SEGMENT_METRICS).count() > 0
    assert len(os.listdir(f"{output_dir}/runs")) == 1


def test_two_runs_on_one_output(spark, tmp_path):
    """Runs that overlap publish one after the other, each whole; only unread old ones go."""
    first, second, third = (snapshots.begin(spark, str(tmp_path)) for _ in range(3))
    for run, n in ((first, 1), (second, 2), (third, 3)):
        spark.range(n).write.parquet(run.path("a"))
    for run, n in ((second, 2), (first, 1)):
        spark.range(n).write.parquet(run.path("b"))
    assert snapshots.publish(second, ["a", "b"]) == 1
    reader = snapshots.current(spark, str(tmp_path))
    assert snapshots.publish(first, ["a", "b"]) == 2
    now = snapshots.current(spark, str(tmp_path))
    assert {spark.read.parquet(path).count() for path in now.values()} == {1}
    assert {spark.read.parquet(path).count() for path in reader.values()} == {2}  # who began before still reads
    assert snapshots.publish(third, ["a"]) == 3
    assert sorted(os.listdir(tmp_path / "runs")) == sorted([first.name, third.name])
    # A taken number is never taken again.
    assert not third.folder.create("{}", "manifests", f"{3:012d}")
    third.discard()
    assert os.listdir(tmp_path / "runs") == [first.name]


def test_a_failed_load_changes_nothing(spark, output_dir, tmp_path, monkeypatch):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS headwise_load LOCATION '{tmp_path}/db'")
    try:
        tables.load_catalog(spark, output_dir, "headwise_load")
        before = {r.tableName for r in spark.sql("SHOW TABLES IN headwise_load").collect()}
        read = tables._read

        def broken(spark, path, table):
            found = read(spark, path, table)
            return found.where(F.raise_error(F.lit("lost"))) if table == tables.ANOMALY_EVENTS else found

        monkeypatch.setattr(tables, "_read", broken)
        with pytest.raises(Exception, match="lost"):
            tables.load_catalog(spark, output_dir, "headwise_load")
        assert {r.tableName for r in spark.sql("SHOW TABLES IN headwise_load").collect()} == before
        assert spark.table("headwise_load.route_scores").count() > 0
    finally:
        spark.sql("DROP DATABASE headwise_load CASCADE")


def test_newest_events_read_only_their_days(spark, network, output_dir):
    events = tables.read_table(spark, output_dir, tables.ANOMALY_EVENTS)
    for given in ({}, {"route_id": "RT-010"}, {"anomaly_type": "gap", "limit": 7}, {"route_id": "none"}):
        want = network.events
        for column in {"route_id", "anomaly_type"} & set(given):
            want = want.where(F.col(column) == given[column])
        want = want.orderBy(F.desc("timestamp"), "route_id", "stop_id", "vehicle_id").limit(given.get("limit", 100))
        newest = serving.anomalies(events, **given)
        assert [tuple(r) for r in newest.collect()] == [tuple(r) for r in want.select(newest.columns).collect()]
        assert [tuple(r) for r in serving.anomalies(network.events, **given).collect()] == [tuple(r) for r in newest.collect()]
    plan = serving.anomalies(events, limit=5)._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "event_date" in filters and "subquery" in filters.lower()


def test_stored_answers(spark, tmp_path):
    path = tmp_path / "answers.json"
    assert tables.read_answers(spark, str(path)).collect() == []
    path.write_text('{"question": "a", "answer": "1", "more": 2}\nno json\n{"question": "b"}\n{"question": "c", "answer": "3"}\n')
    assert rows(tables.read_answers(spark, str(path))) == [("a", "1"), ("c", "3")]


def test_reports_are_stored_looked_up_and_reconciled(spark, network, ping_dir, output_dir):
    path = job.write_reports(spark, ping_dir, output_dir)
    stored = tables.read_answers(spark, path)
    assert stored.count() == 2 + serving.on_latest_date(network.routes).count()
    found = reports.answer_lookup(network.questions, stored)
    assert found.where("answer IS NULL").count() == 0
    assert rows(found) == rows(reports.answer_lookup(network.questions, network.answers))
    checked = job.reconcile(spark, output_dir)
    assert checked.where("not passed").count() == 0 and checked.count() >= 5 + 2 + 8


def test_reports_need_no_pings(spark, ping_dir, output_dir):
    with_pings = rows(tables.read_answers(spark, job.write_reports(spark, ping_dir, output_dir)))
    assert rows(tables.read_answers(spark, job.write_reports(spark, None, output_dir))) == with_pings
    routes, segments = job.published(spark, output_dir)
    plan = reports.answers(routes, segments)._jdf.queryExecution().executedPlan().toString()
    assert "scheduled_min_sum" in plan and ping_dir not in plan
    assert tables.read_table(spark, output_dir, tables.SEGMENT_METRICS).columns == schema.SEGMENTS.names


def test_checks_of_published_tables(spark, output_dir):
    found = {r.check: r.passed for r in job.check(spark, output_dir).collect()}
    # Too few trips for cards at this scale.
    assert len(found) == 10 and found["distinct_dates"] and not found["median_headway_min"] and not found["decision_cards"]


def test_answers_as_json(spark, network, tmp_path):
    answers = reports.answers(network.routes, network.segments, network.pings, "RT-010")
    tables.write_json(answers, str(tmp_path / "answers"))
    back = spark.read.schema("question string, answer string").json(str(tmp_path / "answers"))
    assert rows(back) == rows(answers)


def test_pings_of_other_types_are_cast(spark, network, tmp_path):
    wide = network.pings.withColumns(
        {"stop_sequence": F.col("stop_sequence").cast("bigint"), "dwell_sec": F.col("dwell_sec").cast("int")}
    )
    wide.drop("date").write.parquet(str(tmp_path / "flat"))
    assert rows(ping_source.read_pings(spark, str(tmp_path / "flat"))) == rows(network.pings)


def test_daily_metrics_scan_only_what_they_need(spark, ping_dir):
    pings = ping_source.read_pings(spark, ping_dir)
    plan = metrics.segments_from_pings(pings)._jdf.queryExecution().executedPlan().toString()
    read = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert not any(c in read for c in ("latitude", "longitude", "trip_id"))


def test_command_line(ping_dir, tmp_path):
    def run(*args):
        return subprocess.run(
            [sys.executable, "-m", "headwise", *args], cwd=ROOT, capture_output=True, text=True, timeout=300, check=False
        )

    done = run("--input", ping_dir, "--output", str(tmp_path / "o"), "--timing-file", str(tmp_path / "t.json"), "--publish-failed")
    assert done.returncode == 0, done.stderr
    assert set(json.loads((tmp_path / "t.json").read_text())) >= {"load", "save"}
    assert run("--input", str(tmp_path / "none"), "--output", str(tmp_path / "o")).returncode == 1
    assert run("--input", ping_dir, "--output", str(tmp_path / "p")).returncode == 2
    assert run("report", "--input", ping_dir, "--output", str(tmp_path / "o")).returncode == 0
    assert run("reconcile", "--output", str(tmp_path / "o")).returncode == 0
    failed = run("check", "--output", str(tmp_path / "o"))
    assert failed.returncode == 2 and "median_headway_min" in failed.stderr
    assert run("load", "--output", str(tmp_path / "p"), "--database", "default").returncode == 1


def test_anomalies_need_no_shuffle(network, spark, tmp_path):
    network.flagged.write.parquet(str(tmp_path / "flagged"))
    events = headway.anomaly_events(spark.read.parquet(str(tmp_path / "flagged")))
    assert "Exchange" not in events._jdf.queryExecution().executedPlan().toString()


def test_service_days_include_empty_ones(network):
    pings = network.pings.where("date NOT IN ('2024-01-29', '2024-01-30') AND date != '2024-01-20'")
    days = {r.date: r.pings for r in schedule.service_days(pings, first="2024-01-19").collect()}
    assert len(days) == 10 and max(days) == "2024-01-28" and days["2024-01-20"] == 0
    assert days["2024-01-28"] == pings.where("date = '2024-01-28'").count()


def test_service_days_have_no_limit(spark):
    pings = spark.sql("SELECT CAST(date_add('2024-01-01', CAST(id AS INT)) AS STRING) AS date FROM range(84)")
    assert schedule.service_days(pings).count() == 84


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_latest_date_prunes_published_segments(spark, output_dir):
    worst = serving.worst_segments(tables.read_table(spark, output_dir, tables.SEGMENT_METRICS))
    plan = worst._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "date" in filters and "subquery" in filters.lower()
    assert worst.count() == 10
