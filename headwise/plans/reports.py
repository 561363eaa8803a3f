"""Grounded report answers, their lookup, and their reconciliation with the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwise.config import DEFAULTS, ReliabilityConfig
from headwise.functions import scoring, text
from headwise.operators import metrics
from headwise.plans import serving

# Question keys and the formats whose numbers are reconciled.
FIX_FIRST = "which 5 routes should we fix first"
ROUTE_CHANGE = "why did {} degrade this week"
DAY_TYPES = "compare weekday vs weekend reliability"
ROUTE_SCORE_PATTERN = r"\*\*([^*]+)\*\* \(Score: \*\*(\d+\.\d+)\*\*\)"
CHANGE_PATTERN = (
    r"Route \*\*([^*]+)\*\* saw .*? by \*\*(\d+\.\d+) points\*\* this week "
    r"\(WoW trend: \*\*([+-]?\d+\.\d+)\*\*\)"
)
DAY_TYPE_PATTERN = (
    r"\| \*\*(Weekday|Weekend)\*\* \| \*\*(\d+\.\d+)\*\* \| \*\*(\d+\.\d+)%\*\* \| \*\*(\d+\.\d+)%\*\* \| "
    r"\*\*(\d+\.\d+)s\*\* \|"
)
DAY_TYPE_METRICS = ("avg_score", "bunching_pct", "gap_pct", "avg_dwell")
TOLERANCE = 0.5


def fix_first(routes: DataFrame, segments: DataFrame, pings: DataFrame | None = None, n: int = 5) -> DataFrame:
    """The n worst routes of the latest date with each one's worst stop over all days and what drives it.

    The schedule comes from the pings if they are given, else from the sums that segment metrics keep.
    """
    order = [scoring.rank_key(F.col("reliability_score")), F.col("route_id")]
    worst = (
        serving.on_latest_date(routes)
        .orderBy(*order)
        .limit(n)
        .select(
            F.row_number().over(Window.orderBy(*order)).alias("place"),
            "route_id",
            "reliability_score",
            "mean_headway",
            "wow_trend",
        )
    )
    stops = metrics.worst_stop_per_route(segments)
    schedule = serving.route_schedule(segments if pings is None else pings)
    bunched = F.col("bunching_pct") > F.col("gap_pct")
    rate = text.fixed(F.greatest("bunching_pct", "gap_pct"), 1)
    # n rows, so they are the broadcast side of both joins.
    return (
        F.broadcast(worst)
        .join(stops, "route_id")
        .join(schedule, "route_id")
        .select(
            "place",
            "route_id",
            "reliability_score",
            "stop_id",
            "bunching_pct",
            "gap_pct",
            F.when(bunched, "bunching").otherwise("gap").alias("driver"),
            F.concat(
                F.when(bunched, "vehicles arrive in bunches, **").otherwise("waits are too long, **"),
                rate,
                F.lit("%** of the arrivals at "),
                "stop_id",
            ).alias("key_anomaly"),
            F.when(
                bunched,
                F.concat(
                    F.lit("let early vehicles wait at "),
                    "stop_id",
                    F.lit(" until "),
                    text.fixed(F.col("scheduled_min"), 1),
                    F.lit(" min lie between them."),
                ),
            )
            .otherwise(F.concat(F.lit("run one more peak trip on "), "route_id", F.lit(".")))
            .alias("action"),
        )
        .orderBy("place")
    )


def fix_first_answer(report: DataFrame) -> DataFrame:
    line = F.format_string(
        "%d. **%s** (Score: **%s**)\n   - *Key Anomaly*: %s.\n   - *Action*: %s",
        F.col("place"),
        F.col("route_id"),
        text.fixed(F.col("reliability_score"), 1),
        F.col("key_anomaly"),
        F.col("action"),
    )
    # As many rows as the report lists, so they fit one cell.
    lines = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    return report.agg(
        F.concat(F.lit("### Routes to fix first\n\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n")).alias(
            "answer"
        )
    ).select(F.lit(FIX_FIRST).alias("question"), "answer")


def route_change(
    routes: DataFrame, segments: DataFrame, route_id: str | None = None, cfg: ReliabilityConfig = DEFAULTS
) -> DataFrame:
    """What a route, or every route, looks like on the latest date, with its worst stop over all days."""
    latest = serving.on_latest_date(routes)
    if route_id is not None:
        latest = latest.where(F.col("route_id") == route_id)
        segments = segments.where(F.col("route_id") == route_id)
    stops = metrics.worst_stop_per_route(segments).select(
        "route_id", "stop_id", "bunching_pct", "gap_pct", F.col("mean_dwell_sec").alias("stop_dwell_sec")
    )
    return latest.join(stops, "route_id").select(
        "route_id",
        "reliability_score",
        "wow_trend",
        "mean_headway",
        "stop_id",
        "bunching_pct",
        "gap_pct",
        "stop_dwell_sec",
        "route_base_boardings",
        (F.col("route_base_boardings") * cfg.report_share).cast("bigint").alias("affected_boardings"),
    )


def route_change_answer(report: DataFrame) -> DataFrame:
    trend = F.col("wow_trend")
    answer = F.format_string(
        "### Route change\n"
        "Route **%s** saw its reliability score %s **%s points** this week (WoW trend: **%s**).\n\n"
        "* **Worst stop**: **%s**, average dwell **%ss**\n"
        "* **Headway**: average **%s min**, gap rate **%s%%**\n"
        "* **Impact**: approximately **%s daily boardings** (out of %s base boardings)",
        F.col("route_id"),
        F.when(trend >= 0, "improve by").otherwise("drop by"),
        text.fixed(F.abs(trend), 1),
        text.signed(trend, 1),
        F.col("stop_id"),
        text.fixed(F.col("stop_dwell_sec"), 1),
        text.fixed(F.col("mean_headway"), 1),
        text.fixed(F.col("gap_pct"), 1),
        text.thousands(F.col("affected_boardings")),
        text.thousands(F.col("route_base_boardings")),
    )
    before, after = ROUTE_CHANGE.split("{}")
    question = F.concat(F.lit(before), F.lower("route_id"), F.lit(after))
    return report.select(question.alias("question"), answer.alias("answer"))


def day_type_answer(report: DataFrame) -> DataFrame:
    row = F.format_string(
        "| **%s** | **%s** | **%s%%** | **%s%%** | **%ss** |",
        F.col("day_type"),
        text.fixed(F.col("avg_score"), 1),
        text.fixed(F.col("bunching_pct"), 1),
        text.fixed(F.col("gap_pct"), 1),
        text.fixed(F.col("avg_dwell"), 1),
    )
    header = (
        "### Weekday vs weekend\n\n"
        "| Day Type | Avg Score | Bunching Rate | Gap Rate | Avg Dwell |\n"
        "| :--- | :--- | :--- | :--- | :--- |\n"
    )
    rows = F.array_join(F.array_sort(F.collect_list(row)), "\n")  # two rows
    return report.agg(F.concat(F.lit(header), rows).alias("answer")).select(
        F.lit(DAY_TYPES).alias("question"), "answer"
    )


def answers(
    routes: DataFrame,
    segments: DataFrame,
    pings: DataFrame | None = None,
    route_id: str | None = None,
    cfg: ReliabilityConfig = DEFAULTS,
) -> DataFrame:
    """All report answers as (question, answer), with the change answer for one route or for every route.

    Everything comes from the two tables; the schedule from the pings if they are given (see `fix_first`).
    """
    return (
        fix_first_answer(fix_first(routes, segments, pings))
        .unionByName(route_change_answer(route_change(routes, segments, route_id, cfg)))
        .unionByName(day_type_answer(metrics.weekday_weekend(routes, segments)))
    )


def answer_lookup(asked: DataFrame, answer_table: DataFrame) -> DataFrame:
    """Stored answers for the questions asked, matched on their normalised text; null where none is stored."""
    known = answer_table.select(text.question_key(F.col("question")).alias("question_key"), "answer")
    return asked.select("question", text.question_key(F.col("question")).alias("question_key")).join(
        known, "question_key", "left"
    ).select("question", "question_key", "answer")


def reported_numbers(answer_table: DataFrame) -> DataFrame:
    """Every reconcilable number in the answers, found in one pass: (kind, key, metric, reported)."""

    def found(pattern: str, kind: str, *names: str) -> Column:
        """Group 1 of the pattern is the key, the groups after it are the named metrics."""
        groups = range(1, len(names) + 2)
        parts = [F.regexp_extract_all("answer", F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups]

        def numbers(match: Column) -> Column:
            return F.array(
                *[
                    F.struct(
                        F.lit(kind).alias("kind"),
                        match["g1"].alias("key"),
                        F.lit(name).alias("metric"),
                        match[f"g{g}"].cast("double").alias("reported"),
                    )
                    for g, name in enumerate(names, 2)
                ]
            )

        return F.flatten(F.transform(F.arrays_zip(*parts), numbers))

    return answer_table.select(
        F.inline(
            F.concat(
                found(ROUTE_SCORE_PATTERN, "route", "reliability_score"),
                found(CHANGE_PATTERN, "route", "abs_wow_trend", "wow_trend"),
                found(DAY_TYPE_PATTERN, "day_type", *DAY_TYPE_METRICS),
            )
        )
    )


def expected_numbers(answer_table: DataFrame, routes: DataFrame, segments: DataFrame, n: int = 5) -> DataFrame:
    """What the stored questions must be answered with: (kind, key, metric), whatever their answers say.

    The question what to fix first asks for the scores of the n worst routes, the question about a route for its trend,
    the comparison of day types for all metrics of each. The two general questions are always expected.
    """
    asked = answer_table.select(text.question_key(F.col("question")).alias("question")).distinct()
    worst = serving.leaderboard(routes).limit(n).select("route_id", F.lit("reliability_score").alias("metric"))
    before, after = ROUTE_CHANGE.split("{}")
    question = F.concat(F.lit(before), F.lower("route_id"), F.lit(after))
    changed = serving.on_latest_date(routes).join(asked, question == F.col("question"), "left_semi")
    trends = F.explode(F.array(F.lit("abs_wow_trend"), F.lit("wow_trend")))
    about_routes = worst.unionByName(changed.select("route_id", trends.alias("metric")))
    types = metrics.weekday_weekend(routes, segments).select(
        F.lit("day_type").alias("kind"), F.col("day_type").alias("key"), F.explode(F.array(*map(F.lit, DAY_TYPE_METRICS))).alias("metric")
    )
    return about_routes.select(F.lit("route").alias("kind"), F.col("route_id").alias("key"), "metric").unionByName(types)


def reconcile(
    answer_table: DataFrame, routes: DataFrame, segments: DataFrame, tolerance: float = TOLERANCE
) -> DataFrame:
    """Reported numbers next to the recomputed ones, from both sides.

    A number without counterpart does not pass, and neither does one that a stored question asks for and no answer has.
    """

    def long(table: DataFrame, kind: str, key: str, values: dict[str, Column]) -> DataFrame:
        pairs = [F.struct(F.lit(m).alias("metric"), v.cast("double").alias("actual")) for m, v in values.items()]
        return table.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.inline(F.array(*pairs)))

    trend = F.col("wow_trend")
    route_values = {"reliability_score": F.col("reliability_score"), "wow_trend": trend, "abs_wow_trend": F.abs(trend)}
    day_values = {m: F.col(m) for m in DAY_TYPE_METRICS}
    actual = long(serving.on_latest_date(routes), "route", "route_id", route_values).unionByName(
        long(metrics.weekday_weekend(routes, segments), "day_type", "day_type", day_values)
    )
    number = ["kind", "key", "metric"]
    return (
        reported_numbers(answer_table)
        .join(expected_numbers(answer_table, routes, segments), number, "full")
        .join(actual, number, "left")
        .withColumn(
            "passed", F.coalesce(F.abs(F.col("actual") - F.col("reported")) <= tolerance, F.lit(False))
        )
    )
