"""Each registered query once more, as SQL for DuckDB over the raw tables."""

from __future__ import annotations

ROUTE, FIRST_DAY, SECOND_DAY = "RT-010", "2024-01-23", "2024-01-30"
CLEAN_MIN_TRIPS = 80
GENERAL_QUESTIONS = ["Which 5 routes should we fix first?", "Compare weekday vs. weekend reliability"]

# ---- shared steps; each may use the ones above it ----

PINGS = """
numbered AS (
  SELECT *, user_id % 20 + 1 AS rn, CAST(floor(value) AS BIGINT) AS whole,
    CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS seq
  FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL),
pings AS (
  SELECT ts AS "timestamp",
    'BUS_' || lpad(CAST(rn AS VARCHAR), 3, '0') || '_' || lpad(CAST(whole % 8 AS VARCHAR), 2, '0') AS vehicle_id,
    'RT-' || lpad(CAST(rn AS VARCHAR), 3, '0') AS route_id,
    'STOP_' || lpad(CAST(rn AS VARCHAR), 3, '0') || '_' || event_type AS stop_id,
    CAST(seq AS INTEGER) AS stop_sequence,
    28.40::DOUBLE + rn * 0.02::DOUBLE + seq * 0.002::DOUBLE AS latitude,
    76.84::DOUBLE + rn * 0.02::DOUBLE + seq * 0.003::DOUBLE AS longitude,
    'TRIP_' || CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y-%m-%d') AS trip_id,
    CAST(3600 * (4 + 2 * (rn % 3)) AS BIGINT) AS scheduled_headway_sec,
    whole + 15 AS dwell_sec,
    CAST(CASE rn % 3 WHEN 0 THEN 2500 WHEN 1 THEN 6000 ELSE 15000 END AS BIGINT) AS route_base_boardings,
    strftime(ts, '%Y-%m-%d') AS date
  FROM numbered)"""

HEADWAYS = """
lagged AS (
  SELECT *, epoch_us("timestamp") // 1000000 AS sec,
    lag(epoch_us("timestamp") // 1000000) OVER arrivals AS prev_sec, lag(vehicle_id) OVER arrivals AS prev_vehicle
  FROM pings WINDOW arrivals AS (PARTITION BY route_id, stop_id ORDER BY "timestamp", vehicle_id, stop_sequence, dwell_sec)),
all_headways AS (
  SELECT * EXCLUDE (sec, prev_sec, prev_vehicle),
    CASE WHEN vehicle_id = prev_vehicle THEN NULL ELSE sec - prev_sec END AS headway_sec,
    CASE WHEN vehicle_id = prev_vehicle THEN NULL ELSE (sec - prev_sec) / 60.0::DOUBLE END AS headway_min,
    scheduled_headway_sec / 60.0::DOUBLE AS scheduled_headway_min
  FROM lagged),
flagged AS (
  SELECT *, headway_min < 0.25::DOUBLE * scheduled_headway_min AS is_bunching,
    headway_min > 2.0::DOUBLE * scheduled_headway_min AS is_gap
  FROM all_headways WHERE headway_min IS NOT NULL)"""

ANOMALIES = """
anomalies AS (
  SELECT "timestamp", vehicle_id, route_id, stop_id, stop_sequence, headway_min, scheduled_headway_min, is_bunching,
    is_gap, CASE WHEN is_bunching THEN 'bunching' ELSE 'gap' END AS anomaly_type,
    strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS timestamp_str
  FROM flagged WHERE is_bunching OR is_gap)"""

SEGMENTS = """
counted AS (
  SELECT route_id, stop_id, date, count(*) AS total_trips, avg(headway_min) AS mean_headway,
    coalesce(stddev_samp(headway_min), 0.0::DOUBLE) AS std_headway,
    count(*) FILTER (WHERE is_bunching) AS bunching_count, count(*) FILTER (WHERE is_gap) AS gap_count,
    avg(dwell_sec) AS mean_dwell_sec, max(route_base_boardings) AS route_base_boardings
  FROM flagged GROUP BY route_id, stop_id, date),
rated AS (
  SELECT *, coalesce(std_headway / nullif(mean_headway, 0), 0.0::DOUBLE) AS headway_cov,
    bunching_count / total_trips::DOUBLE AS bunching_rate, gap_count / total_trips::DOUBLE AS gap_rate
  FROM counted),
segments AS (
  SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE * (1.0::DOUBLE - (
      least(headway_cov, 1.0::DOUBLE) * 0.4::DOUBLE
      + least(bunching_rate, 0.5::DOUBLE) / 0.5::DOUBLE * 0.3::DOUBLE
      + least(gap_rate, 0.5::DOUBLE) / 0.5::DOUBLE * 0.3::DOUBLE)))) AS reliability_score
  FROM rated)"""

ROUTES = """
route_days AS (
  SELECT route_id, date, avg(reliability_score) AS reliability_score, avg(mean_headway) AS mean_headway,
    CAST(sum(bunching_count) AS BIGINT) AS bunching_count, CAST(sum(gap_count) AS BIGINT) AS gap_count,
    avg(mean_dwell_sec) AS mean_dwell_sec, max(route_base_boardings) AS route_base_boardings
  FROM segments GROUP BY route_id, date),
compared AS (
  SELECT *, coalesce(lag(reliability_score, 7) OVER (PARTITION BY route_id ORDER BY date), reliability_score)
    AS prev_week_score FROM route_days),
routes AS (SELECT *, reliability_score - prev_week_score AS wow_trend FROM compared),
latest AS (SELECT * FROM routes WHERE date = (SELECT max(date) FROM routes))"""

ROLLUP = """
rollup_all AS (
  SELECT route_id, stop_id, avg(reliability_score) AS reliability_score,
    CAST(sum(total_trips) AS BIGINT) AS total_trips, CAST(sum(bunching_count) AS BIGINT) AS bunching_count,
    CAST(sum(gap_count) AS BIGINT) AS gap_count, avg(mean_dwell_sec) AS mean_dwell_sec,
    max(route_base_boardings) AS route_base_boardings
  FROM segments GROUP BY route_id, stop_id HAVING sum(total_trips) >= 80),
trends AS (SELECT route_id, arg_max(wow_trend, date) AS wow_trend FROM routes GROUP BY route_id)"""

WORST_STOPS = """
stop_totals AS (
  SELECT route_id, stop_id, avg(reliability_score) AS avg_score,
    100.0::DOUBLE * sum(bunching_count) / sum(total_trips) AS bunching_pct,
    100.0::DOUBLE * sum(gap_count) / sum(total_trips) AS gap_pct, avg(mean_dwell_sec) AS mean_dwell_sec
  FROM segments GROUP BY route_id, stop_id),
worst_stops AS (
  SELECT * FROM stop_totals
  QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY round(avg_score, 9), stop_id) = 1)"""

SCHEDULES = """
schedules AS (
  SELECT route_id, avg(scheduled_headway_sec) / 60.0::DOUBLE AS scheduled_min FROM pings GROUP BY route_id)"""

DAY_TYPES = """
day_types AS (
  SELECT s.*, r.bunching_pct, r.gap_pct FROM (
    SELECT CASE WHEN extract(dow FROM CAST(date AS DATE)) IN (0, 6) THEN 'Weekend' ELSE 'Weekday' END AS day_type,
      avg(reliability_score) AS avg_score, avg(mean_dwell_sec) AS avg_dwell FROM routes GROUP BY 1) s
  JOIN (
    SELECT CASE WHEN extract(dow FROM CAST(date AS DATE)) IN (0, 6) THEN 'Weekend' ELSE 'Weekday' END AS day_type,
      100.0::DOUBLE * sum(bunching_count) / sum(total_trips) AS bunching_pct,
      100.0::DOUBLE * sum(gap_count) / sum(total_trips) AS gap_pct FROM segments GROUP BY 1) r USING (day_type))"""


def _cards() -> str:
    """Eight picks, each the most urgent row of its type whose route no earlier pick used."""
    urgency = {
        "bunching": "-bunching_rate",
        "gap": "-gap_rate",
        "dwell": "-mean_dwell_sec",
        "WoW-degrading": "wow_trend",
    }
    steps = [
        """
card_pool AS (
  SELECT p.*, coalesce(t.wow_trend, 0.0::DOUBLE) AS wow_trend, bunching_count / total_trips::DOUBLE AS bunching_rate,
    gap_count / total_trips::DOUBLE AS gap_rate
  FROM rollup_all p LEFT JOIN trends t USING (route_id))"""
    ]
    kinds = list(urgency)
    for i in range(8):
        kind = kinds[i % 4]
        used = "".join(f" AND route_id NOT IN (SELECT route_id FROM pick{j})" for j in range(i))
        steps.append(
            f"""
pick{i} AS (
  SELECT {i + 1} AS card_no, '{kind}' AS card_type, route_id, stop_id AS segment_id, reliability_score, total_trips,
    bunching_rate, gap_rate, mean_dwell_sec, route_base_boardings, wow_trend
  FROM card_pool WHERE true{used}
  ORDER BY round({urgency[kind]}, 9), round(reliability_score, 9), route_id, stop_id LIMIT 1)"""
        )
    steps.append("\ncards AS (" + " UNION ALL ".join(f"SELECT * FROM pick{i}" for i in range(8)) + ")")
    return ",".join(steps)


FIX_FIRST = """
five AS (
  SELECT row_number() OVER (ORDER BY round(reliability_score, 9), route_id) AS place, * FROM latest
  QUALIFY place <= 5),
fix_first AS (
  SELECT CAST(f.place AS INTEGER) AS place, f.route_id, f.reliability_score, w.stop_id, w.bunching_pct, w.gap_pct,
    CASE WHEN w.bunching_pct > w.gap_pct THEN 'bunching' ELSE 'gap' END AS driver,
    CASE WHEN w.bunching_pct > w.gap_pct
      THEN 'vehicles arrive in bunches, **' || printf('%.1f', round(w.bunching_pct, 1)) || '%** of the arrivals at ' || w.stop_id
      ELSE 'waits are too long, **' || printf('%.1f', round(w.gap_pct, 1)) || '%** of the arrivals at ' || w.stop_id
    END AS key_anomaly,
    CASE WHEN w.bunching_pct > w.gap_pct
      THEN 'let early vehicles wait at ' || w.stop_id || ' until '
        || printf('%.1f', round(s.scheduled_min, 1)) || ' min lie between them.'
      ELSE 'run one more peak trip on ' || f.route_id || '.' END AS action
  FROM five f JOIN worst_stops w USING (route_id) JOIN schedules s USING (route_id))"""

ROUTE_CHANGE = """
route_change AS (
  SELECT l.route_id, l.reliability_score, l.wow_trend, l.mean_headway, w.stop_id, w.bunching_pct, w.gap_pct,
    w.mean_dwell_sec AS stop_dwell_sec, l.route_base_boardings,
    CAST(trunc(l.route_base_boardings * 0.15::DOUBLE) AS BIGINT) AS affected_boardings
  FROM latest l JOIN worst_stops w USING (route_id))"""

ANSWERS = r"""
answers AS (
  SELECT 'which 5 routes should we fix first' AS question,
    E'### Routes to fix first\n\n' || string_agg(
      place || '. **' || route_id || '** (Score: **' || printf('%.1f', round(reliability_score, 1)) || E'**)\n'
      || '   - *Key Anomaly*: ' || key_anomaly || E'.\n   - *Action*: ' || action, E'\n\n' ORDER BY place) AS answer
  FROM fix_first
  UNION ALL
  SELECT 'why did ' || lower(route_id) || ' degrade this week',
    E'### Route change\nRoute **' || route_id || '** saw its reliability score '
    || CASE WHEN wow_trend >= 0 THEN 'improve by' ELSE 'drop by' END || ' **'
    || printf('%.1f', round(abs(wow_trend), 1)) || ' points** this week (WoW trend: **'
    || CASE WHEN wow_trend >= 0 THEN '+' ELSE '' END || printf('%.1f', round(wow_trend, 1) + 0.0::DOUBLE)
    || E'**).\n\n* **Worst stop**: **' || stop_id || '**, average dwell **' || printf('%.1f', round(stop_dwell_sec, 1))
    || E's**\n* **Headway**: average **' || printf('%.1f', round(mean_headway, 1)) || ' min**, gap rate **'
    || printf('%.1f', round(gap_pct, 1)) || E'%**\n* **Impact**: approximately **'
    || format('{:,}', affected_boardings) || ' daily boardings** (out of ' || format('{:,}', route_base_boardings)
    || ' base boardings)'
  FROM route_change
  UNION ALL
  SELECT 'compare weekday vs weekend reliability',
    E'### Weekday vs weekend\n\n| Day Type | Avg Score | Bunching Rate | Gap Rate | Avg Dwell |\n'
    || E'| :--- | :--- | :--- | :--- | :--- |\n' || string_agg(
      '| **' || day_type || '** | **' || printf('%.1f', round(avg_score, 1)) || '** | **'
      || printf('%.1f', round(bunching_pct, 1)) || '%** | **' || printf('%.1f', round(gap_pct, 1)) || '%** | **'
      || printf('%.1f', round(avg_dwell, 1)) || 's** |', E'\n' ORDER BY day_type)
  FROM day_types)"""

TABLES = (PINGS, HEADWAYS, ANOMALIES, SEGMENTS, ROUTES, ROLLUP, WORST_STOPS, SCHEDULES, DAY_TYPES)
PING_COLUMNS = (
    '"timestamp", vehicle_id, route_id, stop_id, stop_sequence, round(latitude, 6) AS latitude, '
    "round(longitude, 6) AS longitude, trip_id, scheduled_headway_sec, dwell_sec, route_base_boardings, date"
)
HEADWAY_COLUMNS = (
    f"{PING_COLUMNS}, headway_sec, round(headway_min, 6) AS headway_min, "
    "round(scheduled_headway_min, 6) AS scheduled_headway_min"
)
SEGMENT_COLUMNS = """route_id, stop_id, date, total_trips, round(mean_headway, 6) AS mean_headway,
  round(std_headway, 6) AS std_headway, bunching_count, gap_count, round(mean_dwell_sec, 6) AS mean_dwell_sec,
  route_base_boardings, round(headway_cov, 6) AS headway_cov, round(bunching_rate, 6) AS bunching_rate,
  round(gap_rate, 6) AS gap_rate, round(reliability_score, 6) + 0.0::DOUBLE AS reliability_score"""
ROUTE_COLUMNS = """route_id, date, round(reliability_score, 6) + 0.0::DOUBLE AS reliability_score,
  round(mean_headway, 6) AS mean_headway, bunching_count, gap_count, round(mean_dwell_sec, 6) AS mean_dwell_sec,
  route_base_boardings, round(prev_week_score, 6) AS prev_week_score, round(wow_trend, 6) + 0.0::DOUBLE AS wow_trend"""
EVENT_COLUMNS = """timestamp_str, vehicle_id, route_id, stop_id, stop_sequence, round(headway_min, 6) AS headway_min,
  round(scheduled_headway_min, 6) AS scheduled_headway_min, anomaly_type"""
NEWEST = 'ORDER BY "timestamp" DESC, route_id, stop_id, vehicle_id'
COMPARED = f"route_id = '{ROUTE}' AND date IN ('{FIRST_DAY}', '{SECOND_DAY}')"


def _check(name: str, value: str, source: str, passed: str) -> str:
    return (
        f"SELECT '{name}' AS \"check\", round(v, 6) AS value, coalesce({passed}, false) AS passed "
        f"FROM (SELECT CAST({value} AS DOUBLE) AS v FROM {source})"
    )


def _describe(column: str) -> str:
    return (
        f"SELECT '{column}' AS metric, count({column}) AS count, round(avg({column}), 6) AS mean, "
        f"round(stddev_samp({column}), 6) AS std, round(min({column}), 6) AS min, "
        f"round(quantile_cont({column}, 0.25), 6) AS q1, round(quantile_cont({column}, 0.5), 6) AS median, "
        f"round(quantile_cont({column}, 0.75), 6) AS q3, round(max({column}), 6) AS max FROM routes"
    )


def _reconciled(source: str, kind: str, key: str, metric: str, value: str) -> str:
    return (
        f"SELECT '{kind}' AS kind, {key} AS key, '{metric}' AS metric, "
        f"CAST(printf('%.1f', round({value}, 1)) AS DOUBLE) + 0.0::DOUBLE AS reported, {value} AS actual FROM {source}"
    )


def _report(header: str, lines: str, end: str = "") -> str:
    return f"SELECT E'{header}\\n' || string_agg(line, E'\\n' ORDER BY line_no) || E'{end}' AS report FROM ({lines})"


def statements() -> dict[str, str]:
    """SQL by query name."""
    base = ",".join(TABLES)
    reports = ",".join([base, FIX_FIRST, ROUTE_CHANGE])
    cards = ",".join([base, _cards()])
    day_metrics = ("avg_score", "bunching_pct", "gap_pct", "avg_dwell")
    reconciled = " UNION ALL ".join(
        [_reconciled("fix_first", "route", "route_id", "reliability_score", "reliability_score")]
        + [_reconciled("latest", "route", "route_id", m, v)
           for m, v in (("wow_trend", "wow_trend"), ("abs_wow_trend", "abs(wow_trend)"))]
        + [_reconciled("day_types", "day_type", "day_type", m, m) for m in day_metrics]
    )
    key = "trim(regexp_replace(lower(question), '[?.]', '', 'g'))"
    asked = " UNION ALL ".join(
        ["SELECT '  Why did ' || route_id || ' degrade this week?' AS question FROM latest"]
        + [f"SELECT '{q}'" for q in GENERAL_QUESTIONS]
    )
    steps_body = {
        "headways": (base, f"SELECT {HEADWAY_COLUMNS} FROM all_headways"),
        "anomaly_flags": (base, f"SELECT {HEADWAY_COLUMNS}, is_bunching, is_gap FROM flagged"),
        "daily_segment_metrics": (base, f"SELECT {SEGMENT_COLUMNS} FROM segments"),
        "route_scores": (base, f"SELECT {ROUTE_COLUMNS} FROM routes"),
        "anomaly_events": (base, f"""SELECT "timestamp", is_bunching, is_gap, {EVENT_COLUMNS} FROM anomalies"""),
        "leaderboard": (base, f"SELECT {ROUTE_COLUMNS} FROM latest"),
        "leaderboard_by_headway": (base, f"SELECT {ROUTE_COLUMNS} FROM latest ORDER BY mean_headway DESC"),
        "leaderboard_bands": (
            base,
            """SELECT route_id, round(reliability_score, 6) AS reliability_score,
              CASE WHEN reliability_score < 40 THEN 'red' WHEN reliability_score < 70 THEN 'amber' ELSE 'green' END
                AS score_band,
              round(mean_headway, 6) AS mean_headway, round(mean_dwell_sec, 6) AS mean_dwell_sec,
              round(wow_trend, 6) + 0.0::DOUBLE AS wow_trend,
              CASE WHEN wow_trend > 0.05 THEN 'up' WHEN wow_trend < -0.05 THEN 'down' ELSE 'flat' END
                AS trend_direction FROM latest""",
        ),
        "worst_route": (
            base,
            f"SELECT {ROUTE_COLUMNS} FROM (FROM latest l ORDER BY round(l.reliability_score, 9), route_id LIMIT 1)",
        ),
        "route_timeline": (
            base,
            f"""SELECT date, round(reliability_score, 6) AS reliability_score, round(mean_headway, 6) AS mean_headway,
              round(mean_dwell_sec, 6) AS mean_dwell_sec, bunching_count, gap_count
              FROM routes WHERE route_id = '{ROUTE}'""",
        ),
        "timeline_highlight": (
            base,
            f"""SELECT date, round(reliability_score, 6) AS reliability_score, round(mean_headway, 6) AS mean_headway,
              round(scheduled_min, 6) AS scheduled_min, mean_headway < 0.25::DOUBLE * scheduled_min AS is_highlighted
              FROM routes JOIN schedules USING (route_id) WHERE route_id = '{ROUTE}'""",
        ),
        "worst_segments": (
            base,
            """SELECT route_id, stop_id, round(reliability_score, 6) AS reliability_score, total_trips,
              round(bunching_rate, 6) AS bunching_rate, round(gap_rate, 6) AS gap_rate,
              round(mean_dwell_sec, 6) AS mean_dwell_sec, route_base_boardings
              FROM (SELECT * FROM segments WHERE date = (SELECT max(date) FROM segments)
                ORDER BY round(reliability_score, 9), route_id, stop_id LIMIT 10)""",
        ),
        "worst_segments_report": (
            base,
            _report("Worst Performing Route Segments:", """SELECT place AS line_no, place || '. Route ' || route_id || ', Segment ' || stop_id
                || ': Reliability Score: ' || printf('%.2f', round(reliability_score, 2)) || ', Trips: ' || total_trips
                || ', Bunching Rate: ' || printf('%.1f', round(bunching_rate * 100, 1)) || '%, Gap Rate: '
                || printf('%.1f', round(gap_rate * 100, 1)) || '%' AS line
              FROM (SELECT *, row_number() OVER (ORDER BY round(reliability_score, 9), route_id, stop_id) AS place
                FROM segments WHERE date = (SELECT max(date) FROM segments)) WHERE place <= 5"""),
        ),
        "anomalies_recent": (
            base, f"SELECT {EVENT_COLUMNS} FROM (SELECT * FROM anomalies {NEWEST} LIMIT 100)"
        ),
        "anomalies_filtered": (
            base,
            f"""SELECT {EVENT_COLUMNS} FROM (SELECT * FROM anomalies
              WHERE route_id = '{ROUTE}' AND anomaly_type = 'gap' {NEWEST} LIMIT 100)""",
        ),
        "anomaly_explain": (
            base,
            _report(f"Recent anomaly events for {ROUTE}:", f"""SELECT n AS line_no, '- Time: ' || timestamp_str || ' | Vehicle: ' || vehicle_id
                || ' | Stop: ' || stop_id || ' (Seq ' || stop_sequence || ') | Type: ' || upper(anomaly_type)
                || ' (Headway: ' || printf('%.1f', round(headway_min, 1)) || ' min vs Scheduled: '
                || printf('%.1f', round(scheduled_headway_min, 1)) || ' min)' AS line
              FROM (SELECT *, row_number() OVER ({NEWEST}) AS n FROM anomalies WHERE route_id = '{ROUTE}')
              WHERE n <= 5"""),
        ),
        "compare_periods": (
            base,
            f"""SELECT date, round(reliability_score, 6) AS reliability_score, round(mean_headway, 6) AS mean_headway,
              bunching_count, gap_count FROM routes WHERE {COMPARED}""",
        ),
        "compare_periods_report": (
            base,
            _report(f"Comparison of Route {ROUTE} between {FIRST_DAY} and {SECOND_DAY}:", f"""SELECT
                date AS line_no, '- Date: ' || date
                || ': Reliability: ' || printf('%.2f', round(reliability_score, 2)) || ', Headway: '
                || printf('%.1f', round(mean_headway, 1)) || ' min, Bunching: ' || bunching_count || ', Gaps: '
                || gap_count AS line
              FROM routes WHERE {COMPARED}""", end="\\n"),
        ),
        "route_latest": (
            base,
            f"""SELECT route_id, date, 'Route: ' || route_id || E'\\nDate: ' || date || E'\\nReliability Score: '
                || printf('%.2f', round(reliability_score, 2)) || E' / 100\\nAverage Headway: '
                || printf('%.1f', round(mean_headway, 1)) || E' minutes\\nAverage Dwell Time: '
                || printf('%.1f', round(mean_dwell_sec, 1)) || E' seconds\\nBunching Events Count: ' || bunching_count
                || E'\\nGap Events Count: ' || gap_count AS summary
              FROM routes WHERE route_id = '{ROUTE}' ORDER BY date DESC LIMIT 1""",
        ),
        "network_stats": (
            base,
            """SELECT n AS total_pings,
                CASE WHEN n >= 1000000 THEN printf('%.1f', round(n / 1e6, 1)) || 'M'
                  WHEN n >= 1000 THEN printf('%.0f', round(n / 1e3, 0)) || 'K' ELSE CAST(n AS VARCHAR) END AS pings_label,
                (SELECT count(DISTINCT route_id) FROM routes) AS num_routes,
                (SELECT count(DISTINCT date) FROM routes) AS num_days
              FROM (SELECT count(*) AS n FROM events)""",
        ),
        "health_counts": (
            base,
            """SELECT 'pings' AS table_name, count(*) AS rows FROM events UNION ALL
              SELECT 'route_scores', count(*) FROM routes UNION ALL SELECT 'anomaly_events', count(*) FROM anomalies""",
        ),
        "segment_rollup": (
            base,
            """SELECT route_id, stop_id, round(reliability_score, 6) AS reliability_score, total_trips, bunching_count,
              gap_count, round(mean_dwell_sec, 6) AS mean_dwell_sec, route_base_boardings FROM rollup_all""",
        ),
        "worst_stop_per_route": (
            base,
            """SELECT route_id, stop_id, round(avg_score, 6) AS avg_score, round(bunching_pct, 6) AS bunching_pct,
              round(gap_pct, 6) AS gap_pct, round(mean_dwell_sec, 6) AS mean_dwell_sec FROM worst_stops""",
        ),
        "latest_trend": (base, "SELECT route_id, round(wow_trend, 6) + 0.0::DOUBLE AS wow_trend FROM trends"),
        "decision_cards": (
            cards,
            """SELECT card_no, card_type, route_id, segment_id, round(reliability_score, 6) AS reliability_score,
              total_trips, round(bunching_rate, 6) AS bunching_rate, round(gap_rate, 6) AS gap_rate,
              round(mean_dwell_sec, 6) AS mean_dwell_sec, route_base_boardings,
              round(wow_trend, 6) + 0.0::DOUBLE AS wow_trend FROM cards""",
        ),
        "decision_text": (
            cards,
            """SELECT card_no, route_id, segment_id, round(reliability_score, 1) AS reliability_score,
              CASE WHEN card_type = 'bunching' OR (card_type = 'WoW-degrading' AND wow_trend < -2) THEN 'severe'
                ELSE 'warning' END AS severity,
              CASE card_type
                WHEN 'bunching' THEN 'Severe bus bunching: segment bunching rate is '
                  || printf('%.1f', round(bunching_rate * 100, 1)) || '%.'
                WHEN 'gap' THEN 'Recurring service gaps: segment gap rate is '
                  || printf('%.1f', round(gap_rate * 100, 1)) || '%.'
                WHEN 'dwell' THEN 'Extended dwell congestion: avg dwell is '
                  || printf('%.1f', round(mean_dwell_sec, 1)) || 's.'
                ELSE 'Operational drop: Route WoW trend is ' || printf('%.1f', round(wow_trend, 1)) || ' pts.'
              END AS reason,
              CASE card_type
                WHEN 'bunching' THEN 'Introduce holding point at stop ' || segment_id || ', target headway '
                  || printf('%.1f', round(scheduled_min, 1)) || ' min.'
                WHEN 'gap' THEN 'Add 1 trip in the [' || coalesce(band, 'peak band') || '] on Route ' || route_id || '.'
                WHEN 'dwell' THEN 'Deploy pre-board validation at stop ' || segment_id || ' (avg dwell '
                  || printf('%.1f', round(mean_dwell_sec, 1)) || 's vs network median '
                  || printf('%.1f', round((SELECT median(mean_dwell_sec) FROM segments), 1)) || 's).'
                ELSE 'Flag Route ' || route_id || ' for depot review: score fell '
                  || printf('%.1f', round(abs(wow_trend), 1)) || ' pts.'
              END AS recommended_action,
              'affects ~' || format('{:,}', CAST(trunc(coalesce(nullif(route_base_boardings, 0), 5000) * 0.12::DOUBLE)
                AS BIGINT)) || ' daily boardings' AS rider_impact
              FROM cards LEFT JOIN schedules USING (route_id) LEFT JOIN (
                SELECT route_id, band FROM (
                  SELECT route_id, CASE WHEN h BETWEEN 8 AND 10 THEN '8-10 AM peak band'
                    WHEN h BETWEEN 17 AND 19 THEN '5-7 PM peak band' END AS band, count(*) AS n
                  FROM (SELECT route_id, (epoch_us("timestamp") // 1000000 % 86400) / 3600.0::DOUBLE AS h
                    FROM anomalies WHERE is_gap) GROUP BY 1, 2) WHERE band IS NOT NULL
                QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY n DESC, band) = 1) USING (route_id)""",
        ),
        "top5_fix_first": (
            reports,
            """SELECT place, route_id, round(reliability_score, 6) AS reliability_score, stop_id,
              round(bunching_pct, 6) AS bunching_pct, round(gap_pct, 6) AS gap_pct, driver, key_anomaly, action
              FROM fix_first""",
        ),
        "route_change_report": (
            reports,
            f"""SELECT route_id, round(reliability_score, 6) AS reliability_score, round(wow_trend, 6) AS wow_trend,
              round(mean_headway, 6) AS mean_headway, stop_id, round(bunching_pct, 6) AS bunching_pct,
              round(gap_pct, 6) AS gap_pct, round(stop_dwell_sec, 6) AS stop_dwell_sec, route_base_boardings,
              affected_boardings FROM route_change WHERE route_id = '{ROUTE}'""",
        ),
        "weekday_weekend": (
            base,
            """SELECT day_type, round(avg_score, 6) AS avg_score, round(avg_dwell, 6) AS avg_dwell,
              round(bunching_pct, 6) AS bunching_pct, round(gap_pct, 6) AS gap_pct FROM day_types""",
        ),
        "answer_lookup": (
            f"{reports},{ANSWERS}",
            f"""SELECT a.question, a.question_key, k.answer
              FROM (SELECT question, {key} AS question_key FROM ({asked})) a
              LEFT JOIN (SELECT {key} AS question_key, answer FROM answers) k USING (question_key)""",
        ),
        "report_reconcile": (
            reports,
            f"""SELECT kind, key, metric, reported, round(actual, 6) + 0.0::DOUBLE AS actual,
              abs(actual - reported) <= 0.5 AS passed FROM ({reconciled})""",
        ),
        "quality_checks": (
            base,
            " UNION ALL ".join([
                _check("median_headway_min", "median(mean_headway)", "routes", "v BETWEEN 4 AND 20"),
                _check("max_route_bunching_rate", "max(rate)",
                       "(SELECT avg(bunching_rate) AS rate FROM segments GROUP BY route_id)", "v BETWEEN 0 AND 0.4"),
                _check("dwell_std", "stddev_samp(mean_dwell_sec)", "segments", "v > 0"),
                _check("distinct_dates", "count(DISTINCT date)", "routes", "v >= 25"),
                _check("moving_trend_share", "avg(CASE WHEN abs(wow_trend) > 0.001 THEN 1 ELSE 0 END)", "latest",
                       "v > 0.8"),
            ]),
        ),
        "dwell_spread": (
            base,
            " UNION ALL ".join(
                _check(name, expression, "(SELECT avg(mean_dwell_sec) AS d FROM routes GROUP BY route_id)", passed)
                for name, expression, passed in (
                    ("route_dwell_min", "min(d)", "v <= 35"),
                    ("route_dwell_max", "max(d)", "v >= 90"),
                    ("route_dwell_std", "stddev_samp(d)", "v > 12"),
                )
            ),
        ),
        "clean_fraction_check": (
            base,
            f"""SELECT *, NOT (bunching_pct IN (25.0, 33.3, 50.0, 66.7) OR gap_pct IN (25.0, 33.3, 50.0, 66.7)) AS passed
              FROM (SELECT route_id, stop_id, CAST(sum(total_trips) AS BIGINT) AS total_trips,
                round(100 * (sum(bunching_count) / sum(total_trips)::DOUBLE), 1) AS bunching_pct,
                round(100 * (sum(gap_count) / sum(total_trips)::DOUBLE), 1) AS gap_pct
                FROM segments GROUP BY route_id, stop_id HAVING sum(total_trips) >= {CLEAN_MIN_TRIPS})""",
        ),
        "describe_scores": (base, f"{_describe('mean_headway')} UNION ALL {_describe('mean_dwell_sec')}"),
        "route_stats_fixed": (
            PINGS,
            """SELECT route_id, round(avg(m), 6) AS mean_headway, round(stddev_samp(m), 6) AS std_headway,
                round(avg(CASE WHEN m < 2 THEN 1 ELSE 0 END), 6) AS bunching_rate,
                round(avg(CASE WHEN m > 20 THEN 1 ELSE 0 END), 6) AS gap_rate
              FROM (SELECT route_id, (epoch_us("timestamp") - lag(epoch_us("timestamp")) OVER (
                  PARTITION BY route_id, stop_id ORDER BY "timestamp", vehicle_id, stop_sequence, dwell_sec)) / 1e6 / 60.0::DOUBLE AS m
                FROM pings) WHERE m IS NOT NULL GROUP BY route_id""",
        ),
        "route_headway_debug": (
            f"{PINGS},{HEADWAYS}",
            f"""SELECT "timestamp", stop_id, vehicle_id, sec - prev_sec AS headway_sec FROM lagged
              WHERE route_id = '{ROUTE}'""",
        ),
        "headway_histogram": (
            f"{PINGS},{HEADWAYS}",
            f"""SELECT sec - prev_sec AS headway_sec, count(*) AS pings FROM lagged
              WHERE route_id = '{ROUTE}' AND prev_sec IS NOT NULL GROUP BY 1 ORDER BY pings DESC, 1 LIMIT 10""",
        ),
        "pings_for_day": (PINGS, f"SELECT {PING_COLUMNS} FROM pings WHERE date = '{SECOND_DAY}'"),
        "union_partitions": (PINGS, "SELECT date, count(*) AS pings FROM pings GROUP BY date"),
        "day_bounds_filter": (
            PINGS, f"SELECT {PING_COLUMNS} FROM pings WHERE CAST(\"timestamp\" AS DATE) = CAST(date AS DATE)"
        ),
        "peak_flag": (
            PINGS,
            """SELECT route_id, stop_id, "timestamp", trip_id, round(h, 6) AS hour,
                h BETWEEN 8 AND 10 OR h BETWEEN 17 AND 19 AS is_peak
              FROM (SELECT *, (epoch_us("timestamp") // 1000000 % 86400) / 3600.0::DOUBLE AS h FROM pings)""",
        ),
        "stop_spacing": (
            PINGS,
            """SELECT route_id, stop_id, stop_sequence, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
                round(coalesce(sqrt(power(latitude - lag(latitude) OVER along, 2)
                  + power(longitude - lag(longitude) OVER along, 2)), 0.0::DOUBLE), 6) AS spacing
              FROM (SELECT route_id, stop_id, stop_sequence, avg(latitude) AS latitude, avg(longitude) AS longitude
                FROM pings GROUP BY ALL)
              WINDOW along AS (PARTITION BY route_id ORDER BY stop_sequence, stop_id)""",
        ),
        "service_days": (
            PINGS,
            """SELECT strftime(d, '%Y-%m-%d') AS date, coalesce(n, 0) AS pings
              FROM (SELECT unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS d
                FROM pings) days
              LEFT JOIN (SELECT CAST(date AS TIMESTAMP) AS d, count(*) AS n FROM pings GROUP BY 1) counted USING (d)""",
        ),
    }
    return {name: f"WITH {steps}\n{body}" for name, (steps, body) in steps_body.items()}
