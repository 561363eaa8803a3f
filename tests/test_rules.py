"""Hand-computed results for every rule of the headway and scoring semantics."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from frames import T0, frame, ping
from headwise import DEFAULTS, schema
from headwise.functions import clock, scoring, text
from headwise.operators import headway, metrics, probes
from headwise.plans import serving
from headwise.sources import pings as ping_source


def headway_minutes(spark, rows):
    df = headway.headways(frame(spark, rows)).orderBy("timestamp", "vehicle_id")
    return [r.headway_min for r in df.collect()]


def segment(route="R1", stop="S1", date="2024-01-01", **values):
    row = dict.fromkeys(schema.SEGMENTS.names)
    row.update(
        route_id=route, stop_id=stop, date=date, total_trips=10, mean_headway=10.0, std_headway=1.0, bunching_count=0,
        gap_count=0, mean_dwell_sec=20.0, route_base_boardings=1000, headway_cov=0.1, bunching_rate=0.0, gap_rate=0.0,
        reliability_score=50.0,
    )
    row.update(values)
    return tuple(row[n] for n in schema.SEGMENTS.names)


def test_headway_runs_over_midnight(spark):
    rows = [
        ping(timestamp=dt.datetime(2024, 1, 1, 21, 50), vehicle="A"),
        ping(timestamp=dt.datetime(2024, 1, 2, 6, 10), vehicle="B"),
    ]
    assert headway_minutes(spark, rows) == [None, 500.0]


def test_seconds_are_floored_before_subtracting(spark):
    rows = [
        ping(timestamp=T0.replace(microsecond=999_000), vehicle="A"),
        ping(timestamp=T0.replace(second=1, microsecond=1_000), vehicle="B"),
    ]
    df = headway.headways(frame(spark, rows)).where("headway_sec is not null")
    assert [r.headway_sec for r in df.collect()] == [1]


def test_same_vehicle_has_no_headway_but_still_precedes(spark):
    assert headway_minutes(spark, [ping(0, "A"), ping(5, "A"), ping(12, "B")]) == [None, None, 7.0]


def test_missing_vehicle_equals_no_other(spark):
    assert headway_minutes(spark, [ping(0, None), ping(4, None), ping(9, "A")]) == [None, 4.0, 5.0]


def test_equal_timestamps_are_ordered_by_vehicle(spark):
    flagged = headway.flagged_headways(frame(spark, [ping(0, "B"), ping(0, "A"), ping(8, "B")]))
    rows = flagged.orderBy("timestamp").collect()
    # A before B: B gets headway 0, and the later B repeats the vehicle before it.
    assert [(r.vehicle_id, r.headway_min, r.is_bunching) for r in rows] == [("B", 0.0, True)]


def test_thresholds_are_strict(spark):
    rows = [ping(0, "A"), ping(2.5, "B"), ping(22.5, "C")]  # 25 % and 200 % of 10 minutes
    flagged = headway.flagged_headways(frame(spark, rows)).orderBy("timestamp").collect()
    assert [(r.headway_min, r.is_bunching, r.is_gap) for r in flagged] == [(2.5, False, False), (20.0, False, False)]


def test_missing_schedule_sets_no_flag(spark):
    rows = [ping(0, "A"), ping(1, "B", scheduled_headway_sec=None)]
    flagged = headway.flagged_headways(frame(spark, rows)).collect()
    assert [(r.is_bunching, r.is_gap) for r in flagged] == [(False, False)]


def test_schedule_from_segment_metrics(spark):
    rows = [ping(0, "A", scheduled_headway_sec=6000), ping(5, "B", scheduled_headway_sec=600)]
    rows += [ping(60 * 24, "C", scheduled_headway_sec=1200), ping(60 * 24 + 1, "D", scheduled_headway_sec=None)]
    rows += [ping(0, "A", stop="S2"), ping(9, "B", stop="S2", scheduled_headway_sec=1800)]
    rows += [ping(0, "A", route="R2"), ping(0, "A", route="R3"), ping(1, "B", route="R3", scheduled_headway_sec=None)]
    segments = metrics.segments_from_pings(frame(spark, rows))
    kept = {r.route_id: r.scheduled_min for r in serving.route_schedule(segments).collect()}
    # R1: 10, 20 and 30 minutes; the first ping of a stop has no headway. R3 has a headway, but no schedule.
    assert kept == {"R1": 20.0, "R3": None}
    assert serving.route_schedule(segments.limit(0)).collect() == []
    every = {r.route_id: r.scheduled_min for r in serving.route_schedule(frame(spark, rows)).collect()}
    assert every == {"R1": 34.0, "R2": 10.0, "R3": 10.0}


def test_rows_without_a_key_are_dropped(spark):
    raw = frame(spark, [ping(0, "A"), ping(1, "B", stop=None), ping(2, "B", route=None), ping(3, "C", timestamp=None), ping(5, "B")])
    pings = ping_source.normalize_pings(raw)
    assert pings.count() == 2
    assert [r.headway_min for r in headway.flagged_headways(pings).collect()] == [5.0]


def test_missing_date_has_no_daily_group(spark):
    pings = frame(spark, [ping(0, "A"), ping(5, "B", date=None), ping(9, "A")])
    segments = metrics.segments_from_pings(pings).collect()
    assert [(s.date, s.total_trips, s.mean_headway) for s in segments] == [("2024-01-01", 1, 4.0)]


def test_date_is_derived_when_absent(spark):
    pings = ping_source.normalize_pings(frame(spark, [ping(0)]).drop("date"))
    assert pings.first().date == "2024-01-01"


def test_single_trip_has_no_spread(spark):
    only = metrics.segments_from_pings(frame(spark, [ping(0, "A"), ping(10, "B")])).first()
    assert (only.total_trips, only.std_headway, only.headway_cov, only.reliability_score) == (1, 0.0, 0.0, 100.0)


def test_sample_deviation(spark):
    rows = [ping(0, "A"), ping(8, "B"), ping(20, "A")]  # headways 8 and 12
    only = metrics.segments_from_pings(frame(spark, rows)).first()
    assert only.mean_headway == 10.0
    assert only.std_headway == pytest.approx(8.0**0.5)
    assert only.reliability_score == pytest.approx(100 * (1 - 0.4 * 8.0**0.5 / 10))


def test_all_headways_zero(spark):
    only = metrics.segments_from_pings(frame(spark, [ping(0, "A"), ping(0, "B"), ping(0, "C")])).first()
    assert (only.mean_headway, only.headway_cov, only.bunching_rate) == (0.0, 0.0, 1.0)
    assert only.reliability_score == pytest.approx(70.0)


@pytest.mark.parametrize(
    "cov,bunching,gap,score", [(1.5, 0.5, 0.5, 0.0), (0.0, 1.0, 0.0, 70.0), (0.0, 0.0, 0.0, 100.0), (0.5, 0.25, 0.0, 65.0)]
)
def test_score_formula(spark, cov, bunching, gap, score):
    expression = scoring.reliability_score(F.lit(cov), F.lit(bunching), F.lit(gap), DEFAULTS)
    assert spark.range(1).select(expression).first()[0] == pytest.approx(score)


def test_route_score_is_an_unweighted_mean(spark):
    rows = [
        segment(stop="S1", total_trips=1, reliability_score=100.0, mean_headway=4.0, bunching_count=0, route_base_boardings=10),
        segment(stop="S2", total_trips=9, reliability_score=40.0, mean_headway=8.0, bunching_count=5, route_base_boardings=30),
    ]
    route = metrics.route_metrics(spark.createDataFrame(rows, schema.SEGMENTS)).first()
    assert (route.reliability_score, route.mean_headway, route.bunching_count, route.route_base_boardings) == (70.0, 6.0, 5, 30)


def test_trend_looks_back_seven_rows_not_days(spark):
    dates = ["2024-01-01"] + [f"2024-01-{d:02d}" for d in range(3, 11)]  # the 2nd is missing
    rows = [segment(date=d, reliability_score=float(i)) for i, d in enumerate(dates)]
    routes = metrics.route_scores(spark.createDataFrame(rows, schema.SEGMENTS)).orderBy("date").collect()
    assert [r.wow_trend for r in routes] == [0.0] * 7 + [7.0, 7.0]
    assert (routes[7].date, routes[7].prev_week_score) == ("2024-01-09", 0.0)


def test_gap_label_and_time_text(spark):
    events = headway.anomaly_events(
        headway.flagged_headways(frame(spark, [ping(0, "A"), ping(1, "B", scheduled_headway_sec=0), ping(2, "A")]))
    ).orderBy("timestamp")
    assert [(e.anomaly_type, e.timestamp_str) for e in events.collect()] == [
        ("gap", "2024-01-01 06:01:00"),
        ("bunching", "2024-01-01 06:02:00"),
    ]


def test_bunching_wins_if_both_flags_hold(spark):
    both = replace(DEFAULTS, bunching_threshold=2.0, gap_threshold=0.5)
    events = headway.anomaly_events(headway.flagged_headways(frame(spark, [ping(0, "A"), ping(10, "B")]), both)).collect()
    assert [(e.is_bunching, e.is_gap, e.anomaly_type) for e in events] == [(True, True, "bunching")]


def test_weekend_is_saturday_and_sunday(spark):
    days = spark.createDataFrame([(f"2024-01-{d:02d}",) for d in range(5, 9)], "date string")  # Friday to Monday
    assert [r[0] for r in days.orderBy("date").select(clock.day_type(F.col("date"))).collect()] == [
        "Weekday", "Weekend", "Weekend", "Weekday"]


def test_report_rates_are_ratios_of_sums(spark):
    rows = [
        segment(stop="S1", total_trips=1, bunching_count=1, bunching_rate=1.0),
        segment(stop="S2", total_trips=9, bunching_count=0, bunching_rate=0.0),
    ]
    segments = spark.createDataFrame(rows, schema.SEGMENTS)
    report = metrics.weekday_weekend(metrics.route_scores(segments), segments).first()
    assert (report.day_type, report.bunching_pct) == ("Weekday", 10.0)  # the mean of rates would be 50


def test_support_filter_uses_summed_trips(spark):
    rows = [segment(date=f"2024-01-0{d}", total_trips=40) for d in (1, 2)] + [segment(stop="S2", total_trips=79)]
    rollup = metrics.segment_rollup(spark.createDataFrame(rows, schema.SEGMENTS), min_trips=80)
    assert [r.stop_id for r in rollup.collect()] == ["S1"]


def test_fixed_variant_keeps_fractions_and_repeat_vehicles(spark):
    rows = [
        ping(0, "A"),
        ping(timestamp=T0 + dt.timedelta(seconds=90, milliseconds=600), vehicle="A"),
        ping(timestamp=T0 + dt.timedelta(minutes=30, seconds=90, milliseconds=600), vehicle="B"),
    ]
    stats = probes.route_stats_fixed(frame(spark, rows)).first()
    assert stats.mean_headway == pytest.approx((1.51 + 30.0) / 2)
    assert (stats.bunching_rate, stats.gap_rate) == (0.5, 0.5)


def test_event_text_is_the_wall_clock(spark):
    """02:30 does not exist in New York on this day."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        at = dt.datetime(2024, 3, 10, 2, 30)
        rows = [ping(timestamp=at - dt.timedelta(hours=5), vehicle="A"), ping(timestamp=at, vehicle="B")]
        assert headway.anomaly_events(headway.flagged_headways(frame(spark, rows))).first().timestamp_str == "2024-03-10 02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_histogram_counts_headways_most_frequent_first(spark):
    rows = [ping(m, "A") for m in (0, 5, 10, 12, 14, 16)]
    histogram = probes.headway_histogram(probes.route_headways(frame(spark, rows), "R1"), limit=2)
    assert [(r.headway_sec, r.pings) for r in histogram.collect()] == [(120, 3), (300, 2)]


def test_results_do_not_depend_on_the_session_time_zone(spark):
    rows = [ping(timestamp=dt.datetime(2024, 3, 10, 1, 30), vehicle="A"), ping(timestamp=dt.datetime(2024, 3, 10, 3, 30), vehicle="B")]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # the hour between does not exist there
        assert headway_minutes(spark, rows) == [None, 120.0]
        stats = probes.route_stats_fixed(frame(spark, rows)).first()
        assert stats.mean_headway == 120.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("stamp", ["2024-02-29 23:59:59.999999", "1969-12-31 23:59:58.5", "1970-01-01 00:00:00", "1900-01-01 00:00:00.1"])
def test_clock_rounds_down(spark, stamp):
    moment = dt.datetime.fromisoformat(stamp)
    since = (moment - dt.datetime(1970, 1, 1)) // dt.timedelta(seconds=1)
    ts = F.lit(stamp).cast("timestamp_ntz")
    got = spark.range(1).select(clock.wall_seconds(ts), clock.day_number(ts), clock.minute_number(ts), clock.hour_fraction(ts)).first()
    assert tuple(got) == (since, since // 86400, since // 60, pytest.approx(since % 86400 / 3600))


def test_small_expressions(spark):
    def value(column):
        return spark.range(1).select(column).first()[0]

    assert value(text.human_count(F.lit(1_234_567))) == "1.2M"
    assert value(text.human_count(F.lit(34_400))) == "34K"
    assert value(text.human_count(F.lit(999))) == "999"
    assert value(text.thousands(F.lit(15000 * 0.12))) == "1,800"
    assert value(text.signed(F.lit(-1.25), 1)) == "-1.3"
    assert value(text.signed(F.lit(2.0), 1)) == "+2.0"
    assert value(text.route_number(F.lit("RT-010"))) == 10
    assert value(text.route_number(F.lit("express"))) is None
    assert value(text.question_key(F.lit(" Why did RT-010 degrade this week?. "))) == "why did rt-010 degrade this week"
    assert [value(scoring.score_band(F.lit(s))) for s in (39.99, 40.0, 69.99, 70.0)] == ["red", "amber", "amber", "green"]
    assert [value(scoring.trend_direction(F.lit(t))) for t in (0.05, 0.06, -0.05, -0.06)] == ["flat", "up", "flat", "down"]
    assert value(scoring.ratio(F.lit(0), F.lit(0))) == 0.0


def test_peak_bands_include_both_ends(spark):
    hours = spark.createDataFrame([Row(h=h) for h in (7.99, 8.0, 10.0, 10.01, 17.0, 19.0, 19.01)])
    assert [r[0] for r in hours.orderBy("h").select(clock.is_peak(F.col("h"))).collect()] == [
        False, True, True, False, True, True, False]
