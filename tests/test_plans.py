"""Cards, reports, checks, percentiles, schedule, serving."""

from __future__ import annotations

import random
import statistics
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from frames import frame, ping
from headwise import DEFAULTS, schema
from headwise.operators import metrics, quality, quantiles, schedule
from headwise.plans import decisions, reports, serving
from headwise.sources import pings as ping_source
from headwise.sources import tables
from test_rules import segment


def network(spark, seed=0, routes=10, stops=2, tied=False):
    """Segments and routes of a small random network over ten dates."""
    rng = random.Random(seed)
    rows = []
    for r in range(routes):
        for s in range(stops):
            for d in range(1, 11):
                bunched, gaps = (2, 1) if tied else (rng.randrange(6), rng.randrange(4))
                rows.append(
                    segment(
                        f"RT-{r:03d}",
                        f"S{r:03d}_{s}",
                        f"2024-01-{d:02d}",
                        total_trips=10,
                        bunching_count=bunched,
                        gap_count=gaps,
                        mean_dwell_sec=30.0 if tied else float(rng.randrange(20, 90)),
                        reliability_score=50.0 if tied else float(rng.randrange(101)),
                        bunching_rate=bunched / 10,
                        gap_rate=gaps / 10,
                    )
                )
    segments = spark.createDataFrame(rows, schema.SEGMENTS)
    return segments, metrics.route_scores(segments)


def replay_cards(segments, routes, cfg):
    """Round by round: sort the pool for the card's type and take the first unused route."""
    pool = [r.asDict() for r in metrics.segment_rollup(segments, cfg.min_trips).collect()]
    trend = {r.route_id: r.wow_trend for r in metrics.latest_trend(routes).collect()}
    urgency = [
        lambda r: -r["bunching_count"] / r["total_trips"],
        lambda r: -r["gap_count"] / r["total_trips"],
        lambda r: -r["mean_dwell_sec"],
        lambda r: trend.get(r["route_id"], 0.0),
    ]
    used, cards = set(), []
    for turn in range(cfg.n_cards):
        key = urgency[turn % 4]
        order = sorted(
            pool, key=lambda r: (round(key(r), 9), round(r["reliability_score"], 9), r["route_id"], r["stop_id"])
        )
        for row in order:
            if row["route_id"] not in used:
                used.add(row["route_id"])
                cards.append((turn + 1, decisions.CARD_TYPES[turn % 4], row["route_id"], row["stop_id"]))
                break
    return cards


@pytest.mark.parametrize("seed,tied,routes", [(1, False, 10), (2, False, 30), (3, True, 10), (4, False, 5)])
def test_cards_equal_a_round_by_round_replay(spark, seed, tied, routes):
    segments, scores = network(spark, seed, routes, tied=tied)
    cards = decisions.decision_cards(segments, scores).orderBy("card_no").collect()
    got = [(c.card_no, c.card_type, c.route_id, c.segment_id) for c in cards]
    assert got == replay_cards(segments, scores, DEFAULTS)
    assert len({c.route_id for c in cards}) == len(cards) == min(8, routes)


def test_cards_respect_support(spark):
    segments, scores = network(spark, 5, 12)
    assert decisions.decision_cards(segments, scores, replace(DEFAULTS, min_trips=101)).count() == 0


def test_cards_choose_from_all_stops(spark):
    """The stop with the highest bunching rate gets the first card, though 1,100 stops have a lower score."""
    columns = schema.SEGMENTS
    row = {"date": "2024-01-01", "total_trips": 100, "mean_headway": 5.0, "gap_count": 0, "mean_dwell_sec": 20.0}
    rows = [row | {"route_id": f"RT-{i:04d}", "stop_id": "S", "bunching_count": 10, "reliability_score": 30.0} for i in range(1100)]
    rows.append(row | {"route_id": "RT-9999", "stop_id": "S", "bunching_count": 49, "reliability_score": 60.0})
    segments = spark.createDataFrame([[r.get(f.name) for f in columns] for r in rows], columns)
    cards = decisions.decision_cards(segments, metrics.route_scores(segments))
    assert cards.where("card_no = 1").first().route_id == "RT-9999"


def test_counts_include_rows_without_keys(spark):
    pings = frame(spark, [ping(0), ping(1, route=None)])
    routes = metrics.route_scores(spark.createDataFrame([], schema.SEGMENTS))
    assert serving.network_stats(pings, routes).first().total_pings == 2


def test_card_text(spark):
    segments, scores = network(spark, 6)
    pings = frame(spark, [ping(0, route=f"RT-{r:03d}", scheduled_headway_sec=480) for r in range(10)])
    events = spark.createDataFrame(
        [(ping(h * 60)[0], "A", "RT-001", "S", 0, 30.0, 8.0, False, True, "gap", "") for h in (2, 3, 11.5)], schema.ANOMALIES
    )
    cards = decisions.decision_cards(segments, scores)
    rows = decisions.decision_text(cards, segments, events, serving.route_schedule(pings)).collect()
    assert [r.card_no for r in rows] == list(range(1, 9))
    assert rows[0].severity == "severe" and "target headway 8.0 min." in rows[0].recommended_action
    assert rows[0].rider_impact == "affects ~120 daily boardings"
    median = statistics.median(r.mean_dwell_sec for r in segments.collect())
    assert f"vs network median {median:.1f}s" in rows[2].recommended_action
    assert [r.band for r in decisions.peak_band(events).collect()] == ["8-10 AM peak band"]


def test_reports_reconcile_and_a_wrong_number_does_not(spark):
    segments, scores = network(spark, 7)
    pings = frame(spark, [ping(0, route=f"RT-{r:03d}") for r in range(10)])
    answers = reports.answers(scores, segments, pings)
    assert answers.count() == 12
    checked = reports.reconcile(answers, scores, segments).collect()
    assert len(checked) == 5 + 2 * 10 + 8
    assert all(r.passed for r in checked)

    first = next(r for r in checked if r.metric == "reliability_score")
    text = f"**{first.key}** (Score: **{first.actual + 0.6:.1f}**) and **RT-999** (Score: **1.0**)"
    forged = spark.createDataFrame([("q", text)], "question string, answer string")
    found = reports.reconcile(forged, scores, segments).collect()
    assert not any(r.passed for r in found)
    assert {r.key for r in found if r.reported is not None} == {first.key, "RT-999"}
    # The five scores (one of them reported) and both day types are expected, whatever is stored.
    assert len([r for r in found if r.key != "RT-999"]) == 5 + 8


def test_an_answer_without_its_numbers_does_not_pass(spark):
    segments, scores = network(spark, 7)
    pings = frame(spark, [ping(0, route=f"RT-{r:03d}") for r in range(10)])
    answers = reports.answers(scores, segments, pings)
    asked = F.col("question") == "why did rt-003 degrade this week"
    stripped = answers.withColumn("answer", F.when(asked, F.regexp_replace("answer", r"\d", "")).otherwise(F.col("answer")))
    missing = [(r.key, r.metric) for r in reports.reconcile(stripped, scores, segments).collect() if not r.passed]
    assert sorted(missing) == [("RT-003", "abs_wow_trend"), ("RT-003", "wow_trend")]
    # Without the stored question nobody expects its answer; the general ones are always expected.
    assert all(r.passed for r in reports.reconcile(answers.where(~asked), scores, segments).collect())
    none = reports.reconcile(answers.limit(0), scores, segments).collect()
    assert len(none) == 5 + 8 and not any(r.passed for r in none)


def test_extraction_finds_every_score(spark):
    items = "\n".join(f"{i}. **RT-{i:03d}** (Score: **{30 + i}.5**)" for i in range(1, 6))
    found = reports.reported_numbers(spark.createDataFrame([("q", items)], "question string, answer string"))
    assert sorted((r.key, r.metric, r.reported) for r in found.collect()) == [
        (f"RT-{i:03d}", "reliability_score", 30.5 + i) for i in range(1, 6)]


def test_answer_lookup_keeps_unknown_questions(spark):
    asked = spark.createDataFrame([(" Compare Weekday vs Weekend reliability?",), ("Is it raining?",)], "question string")
    stored = spark.createDataFrame([(reports.DAY_TYPES, "table")], "question string, answer string")
    found = {r.question: r.answer for r in reports.answer_lookup(asked, stored).collect()}
    assert found == {" Compare Weekday vs Weekend reliability?": "table", "Is it raining?": None}


@pytest.mark.parametrize("probability", [0.0, 0.25, 1.0])
@pytest.mark.parametrize(
    "values",
    [
        [3.0],
        [1.0, 2.0],
        [float(i * i % 977) for i in range(5000)],
        [5.0] * 3000 + [float(i) for i in range(1500)],
        [1e9, -1e9] + [random.Random(1).gauss(0, 1) for _ in range(4000)],
    ],
)
def test_percentile_is_exact(spark, values, probability):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(7)
    got = quantiles.percentile(df, "x", probability).first().value
    assert got == pytest.approx(np.percentile(values, probability * 100), abs=1e-9)


def test_percentile_of_nothing_is_null(spark):
    assert quantiles.median(spark.createDataFrame([], "x double"), "x").first().value is None


def test_every_rank_of_awkward_doubles(spark):
    """Every value of the table comes back at its own rank: signs, neighbours, powers of two, the smallest, infinities."""
    some = [0.0, 5e-324, 1e-310, 2.0**-1022, 1.0, 2.0, 0.1, 3.0, 1e16, 1e300, 1.7976931348623157e308, float("inf"), 2.0**52, 2.0**53]
    some += [float(np.nextafter(x, d)) for x in (1.0, 2.0, 1024.0, 2.0**-950, 2.0**-899) for d in (0, 9e9)]
    rng = random.Random(5)
    some += [np.frombuffer(rng.randbytes(8)).item() for _ in range(60)]
    values = sorted({x for v in some if v == v for x in (v, -v)} | {7.0})
    values = [v + 0.0 for v in values if v != 0] + [0.0]
    values.sort()
    df = spark.createDataFrame([(v,) for v in [*values, float("nan")]] + [(None,)], "x double").repartition(5)
    ranks = list(range(0, len(values), 7)) + [len(values) - 1]
    got = {r.probability: r.value for r in quantiles.percentiles(df, "x", [k / (len(values) - 1) for k in ranks]).collect()}
    found = [min(values, key=lambda v, g=g: (v != g, abs(values.index(v)))) for g in got.values() if g == g]
    for k in ranks:
        p = k / (len(values) - 1)
        if (len(values) - 1) * p == k:  # a rank that the probability names exactly
            assert got[p] == values[k]
    assert len(found) > len(ranks) / 2


def test_quartiles_share_their_passes(spark):
    df = spark.range(200_000).selectExpr("cast(id as double) as x")
    got = [tuple(r) for r in quantiles.percentiles(df, "x", [0.25, 0.5, 0.75]).collect()]
    assert got == [(0.25, 49_999.75), (0.5, 99_999.5), (0.75, 149_999.25)]
    plan = quantiles.percentiles(df, "x", [0.25, 0.5, 0.75])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 200000") == quantiles.READS


@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_percentiles_do_not_depend_on_the_ranges(spark, partitions):
    values = [0.0] * 900 + [-0.0] * 100 + [float(i % 40) for i in range(2000)] + [1e6 + i for i in range(11)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(6)
    probabilities = [0.0, 0.1, 0.33, 0.5, 0.9, 0.999, 1.0]
    got = [r.value for r in quantiles.percentiles(df, "x", probabilities, partitions).collect()]
    assert got == pytest.approx([np.percentile(values, 100 * p) for p in probabilities], abs=1e-9)


def test_quality_checks(spark):
    segments, scores = network(spark, 8)
    checks = {r.check: (r.value, r.passed) for r in quality.quality_checks(scores, segments).collect()}
    assert checks["median_headway_min"] == (10.0, True)
    assert checks["distinct_dates"] == (10.0, False)
    rates = {}
    for r in segments.collect():
        rates.setdefault(r.route_id, []).append(r.bunching_rate)
    assert checks["max_route_bunching_rate"][0] == pytest.approx(max(statistics.mean(v) for v in rates.values()))
    latest = [r for r in scores.collect() if r.date == "2024-01-10"]
    assert checks["moving_trend_share"][0] == pytest.approx(sum(abs(r.wow_trend) > 0.001 for r in latest) / len(latest))


def test_clean_fractions_are_reported(spark):
    rows = [
        segment(stop="S1", total_trips=200, bunching_count=50, gap_count=1),
        segment(stop="S2", total_trips=200, bunching_count=51, gap_count=1),
        segment(stop="S3", total_trips=199, bunching_count=50, gap_count=1),
        segment(stop="S4", total_trips=300, bunching_count=1, gap_count=100),
    ]
    checks = quality.clean_fraction_check(spark.createDataFrame(rows, schema.SEGMENTS)).collect()
    assert {c.stop_id: c.passed for c in checks} == {"S1": False, "S2": True, "S4": False}


def test_dwell_spread(spark):
    rows = [segment(f"R{i}", mean_dwell_sec=d) for i, d in enumerate((30.0, 60.0, 95.0))]
    routes = metrics.route_scores(spark.createDataFrame(rows, schema.SEGMENTS))
    got = {r.check: (r.value, r.passed) for r in quality.dwell_spread(routes).collect()}
    assert got["route_dwell_min"] == (30.0, True) and got["route_dwell_max"] == (95.0, True)
    assert got["route_dwell_std"][0] == pytest.approx(statistics.stdev([30, 60, 95])) and got["route_dwell_std"][1]


def test_leaderboard_sort_column_is_checked(spark):
    _, scores = network(spark, 9)
    by_score = [r.route_id for r in serving.leaderboard(scores).collect()]
    assert [r.route_id for r in serving.leaderboard(scores, "1; drop table x").collect()] == by_score
    values = [r.mean_dwell_sec for r in serving.leaderboard(scores, "mean_dwell_sec", ascending=False).collect()]
    assert values == sorted(values, reverse=True)
    assert {r.date for r in serving.leaderboard(scores).collect()} == {"2024-01-10"}


def test_limits_are_checked(spark):
    segments, _ = network(spark, 10)
    for limit in (0, 1001):
        with pytest.raises(ValueError):
            serving.worst_segments(segments, limit)


def test_unknown_route_gives_no_rows(spark):
    segments, scores = network(spark, 11)
    assert serving.route_timeline(scores, "RT-999").count() == 0
    assert [tuple(r) for r in serving.route_latest(scores, "RT-999").collect()] == [("RT-999", None, "No data for route RT-999.")]
    assert reports.route_change(scores, segments, "RT-999").count() == 0


def test_comparison_text_needs_both_dates(spark):
    _, scores = network(spark, 12)
    both = serving.compare_periods_report(scores, "RT-001", "2024-01-01", "2024-01-02").first().report
    lines = both.split("\n")
    assert lines[0] == "Comparison of Route RT-001 between 2024-01-01 and 2024-01-02:"
    assert [line[:20] for line in lines[1:]] == ["- Date: 2024-01-01: ", "- Date: 2024-01-02: ", ""]
    one = serving.compare_periods_report(scores, "RT-001", "2024-01-01", "2024-02-02").first().report
    assert one.startswith("Compare error: Could not find data for route RT-001")


def test_texts_for_missing_data(spark):
    segments, _ = network(spark, 13)
    empty = spark.createDataFrame([], schema.ANOMALIES)
    assert serving.anomaly_explain(empty, "RT-001").first().report == "No recent anomalies recorded for RT-001."
    none = serving.worst_segments_report(segments.where("false")).first().report
    assert none == "No segment metrics available in the database."
    worst = serving.worst_segments_report(segments, 3).first().report.split("\n")
    assert len(worst) == 4 and worst[1].startswith("1. Route RT-")


def test_foreign_tables_get_our_schema(spark, tmp_path):
    df = spark.createDataFrame([("R", 1.5, 3, 9), ("S", float("nan"), None, 9)], "route_id string, wow_trend double, gap_count int, more int")
    df.write.parquet(str(tmp_path / "t"))
    read = tables.read_foreign(spark, str(tmp_path / "t"), tables.ROUTE_SCORES)
    assert read.schema == schema.ROUTES
    assert [(r.route_id, r.wow_trend, r.gap_count, r.date) for r in read.orderBy("route_id").collect()] == [("R", 1.5, 3, None), ("S", None, None, None)]


def test_counts_come_from_footers(spark, tmp_path):
    frame(spark, [ping(i) for i in range(30)]).write.partitionBy("date").parquet(str(tmp_path / "p"))
    counted = ping_source.for_counting(spark, str(tmp_path / "p"))
    n = counted.agg(F.count(F.lit(1)).alias("n"))
    assert n.first().n == 30
    plan = n._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan
    assert counted.where("stop_id = 'S1'").count() == 30  # a scan, where footers don't tell
    _, scores = network(spark, 3)
    stats = serving.network_stats(counted, scores)
    assert "PushedAggregation: [COUNT(*)]" in stats._jdf.queryExecution().executedPlan().toString() and stats.first().total_pings == 30
    later = spark.read.parquet(str(tmp_path / "p"))
    assert "BatchScan" not in later._jdf.queryExecution().executedPlan().toString()


def test_stop_spacing(spark):
    rows = [
        ping(0, stop="S1", stop_sequence=0, latitude=0.0, longitude=0.0),
        ping(1, stop="S2", stop_sequence=1, latitude=3.0, longitude=4.0),
        ping(2, stop="S2", stop_sequence=1, latitude=3.0, longitude=4.0),
        ping(3, stop="S3", stop_sequence=2, latitude=3.0, longitude=5.0),
    ]
    spacing = schedule.stop_spacing(frame(spark, rows)).orderBy("stop_sequence").collect()
    assert [s.spacing for s in spacing] == [0.0, 5.0, 1.0]


def test_day_bounds(spark):
    pings = frame(spark, [ping(0), ping(1, date="2023-12-31")])
    assert ping_source.within_day_bounds(pings).count() == 1
