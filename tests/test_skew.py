"""Series of any length give the same headways as a plain replay."""

from __future__ import annotations

import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from frames import FINE, NAMES, frame, ping, replay
from headwise import DEFAULTS
from headwise.operators import headway, metrics, probes, series


def _random_pings(seed, hot_day=False, copies=0, copied_vehicle="A", trips=0):
    rng = random.Random(seed)
    rows = []
    for _ in range(300):
        rows.append(
            ping(
                rng.uniform(0, 10 * 1440),
                rng.choice(["A", "B", "C", None]),
                route=rng.choice(["R1", "R2", "R3"]),
                stop=rng.choice(["S1", "S2", "S3", "S4"]),
                trip_id=f"T{rng.randrange(3)}",
            )
        )
    # One stop holds more than a third of all rows, over several days, or within one day.
    span = (3 * 1440, 1440) if hot_day else (0, 10 * 1440)
    for _ in range(400):
        rows.append(ping(span[0] + rng.uniform(0, span[1]), rng.choice(["A", "B", None]), "R1", "S1", dwell_sec=rng.randrange(9)))
    rows += [ping(3 * 1440 + 100, copied_vehicle, "R1", "S1")] * copies
    # One moment with many trips, no two alike.
    rows += [ping(3 * 1440 + 100, rng.choice(["A", "B", None]), "R1", "S1", trip_id=f"T{i}") for i in range(trips)]
    rng.shuffle(rows)
    return rows


def _computed(df):
    return sorted((tuple(r) for r in df.select(*NAMES, "headway_sec").collect()), key=repr)


@pytest.mark.parametrize("hot_day", [False, True])
@pytest.mark.parametrize("copies,vehicle", [(0, "A"), (900, "A"), (900, None)])
def test_headways_under_skew(spark, hot_day, copies, vehicle):
    rows = _random_pings(1, hot_day, copies, vehicle)
    pings = frame(spark, rows)
    assert _computed(headway.headways(pings, FINE)) == replay(rows)


@pytest.mark.parametrize("partitions", [1, 4, 400])
def test_a_heavy_minute_of_distinct_trips(spark, partitions):
    rows = _random_pings(2, copies=40, trips=1500)
    names = [c for c in headway.FULL_ORDER if c in NAMES]
    found = series.with_previous(frame(spark, rows), headway.STOP, names, headway.PREVIOUS, partitions)
    sizes = found.groupBy(F.spark_partition_id()).count().collect()
    if partitions == 4:
        assert len(sizes) == 4 and max(r["count"] for r in sizes) < len(rows) / 2
    if partitions == 400:
        assert len(sizes) > 100 and max(r["count"] for r in sizes) <= 60  # copies of one row stay together
    seconds = F.unix_seconds(F.col("timestamp").cast("timestamp")) - F.unix_seconds(F.col("prev_timestamp").cast("timestamp"))
    same = F.col("vehicle_id") == F.col("prev_vehicle_id")
    assert _computed(found.withColumn("headway_sec", F.when(same, None).otherwise(seconds))) == replay(rows)


def test_previous_rows_of_any_table(spark):
    """Null series, ties, repeated rows, extra columns, an empty table; against a sort in plain Python."""
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), rng.choice([1, 2, 3, None]), rng.randrange(4), rng.random() < 0.5) for _ in range(500)]
    table = spark.createDataFrame(data, "k string, at int, value long, last boolean")
    got = series.with_previous(table, ["k"], ["at"], {"value": "before"}, 16)
    assert got.columns == ["k", "at", "value", "last", "before"]
    null_first = lambda row: [(x is not None, x) if x is not None else (False, 0) for x in row]
    want, before = [], None
    for row in sorted(data, key=null_first):
        want.append((*row, before[2] if before and before[0] == row[0] else None))
        before = row
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert series.with_previous(table.limit(0), ["k"], ["at"], {"value": "before"}).collect() == []


def test_filters_stay_above_the_series(spark):
    rows = _random_pings(5)
    pings = frame(spark, rows)
    late = F.col("timestamp") > F.lit("2024-01-05").cast("timestamp_ntz")
    want = [r for r in replay(rows) if str(r[NAMES.index("timestamp")]) > "2024-01-05"]
    for cfg in (FINE, DEFAULTS):
        assert _computed(headway.headways(pings, cfg).where(late)) == want


def _plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def test_nothing_runs_before_the_result_is_asked_for(spark):
    pings = frame(spark, _random_pings(4)).where(F.assert_true(F.lit(False), "ran").isNull())
    headway.headways(pings, FINE)
    metrics.segments_from_pings(pings, FINE)
    with pytest.raises(Exception, match="ran"):
        headway.headways(pings, FINE).collect()


def test_only_long_stops_are_sorted_over_several_tasks(spark, tmp_path):
    frame(spark, _random_pings(4)).write.parquet(str(tmp_path / "p"))
    pings = spark.read.parquet(str(tmp_path / "p"))
    plain = _plan(headway.headways(pings))
    assert "rangepartitioning" not in plain and "ArrowEvalPython" not in plain
    long = _plan(headway.headways(pings, replace(DEFAULTS, split_rows=200)))
    assert "rangepartitioning" in long and "Window" in long
    # Both readers of the range partitions read one shuffle.
    assert len(re.findall(r"Exchange rangepartitioning", long)) == len(re.findall(r"ReusedExchange.*rangepartitioning|Exchange rangepartitioning", long))


def test_metrics_do_not_depend_on_splitting(spark):
    pings = frame(spark, _random_pings(4, hot_day=True, copies=500, copied_vehicle=None))
    split = metrics.segments_from_pings(pings, FINE)
    whole = metrics.segments_from_pings(pings)

    def rows(df):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())

    assert rows(split) == rows(whole)


def test_fixed_stats_do_not_depend_on_splitting(spark):
    pings = frame(spark, _random_pings(5, copies=300))

    def rows(df):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())

    assert rows(probes.route_stats_fixed(pings, FINE)) == rows(probes.route_stats_fixed(pings))


def test_result_ignores_input_order_and_partitions(spark):
    rows = _random_pings(6)
    want = replay(rows)
    for seed, partitions in ((7, 1), (8, 13)):
        random.Random(seed).shuffle(rows)
        pings = frame(spark, rows).repartition(partitions)
        assert _computed(headway.headways(pings)) == want
        assert _computed(headway.headways(pings, FINE)) == want


def test_plain_data_needs_one_shuffle_of_pings(spark, tmp_path):
    frame(spark, [ping(i, f"V{i}", "R1", f"S{i % 40}") for i in range(400)]).write.parquet(str(tmp_path / "p"))
    plan = _plan(metrics.segments_from_pings(spark.read.parquet(str(tmp_path / "p"))))
    # One by (route, stop) for the headways, whose daily groups need no other; the other counts pings by stop.
    assert plan.count("Exchange hashpartitioning") <= 2
    assert "latitude" not in plan
