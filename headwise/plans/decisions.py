"""Decision cards: a short list of interventions, each on a different route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwise.config import DEFAULTS, ReliabilityConfig
from headwise.functions import clock, scoring, text
from headwise.operators import metrics, quantiles

# Card types in the order in which they take turns.
CARD_TYPES = ("bunching", "gap", "dwell", "WoW-degrading")
SEVERE_DROP = -2.0


def _candidates(segments: DataFrame, routes: DataFrame, cfg: ReliabilityConfig) -> DataFrame:
    """For every card type, the stops that could still be picked when its turn comes.

    A route gets one card at most, so only its best stop counts, and the i-th card can find at most i routes taken:
    the best `n_cards` routes per type are enough.
    """
    pool = (
        metrics.segment_rollup(segments, cfg.min_trips)
        .join(metrics.latest_trend(routes), "route_id", "left")
        .withColumns(
            {
                "wow_trend": F.coalesce("wow_trend", F.lit(0.0)),
                "bunching_rate": scoring.ratio(F.col("bunching_count"), F.col("total_trips")),
                "gap_rate": scoring.ratio(F.col("gap_count"), F.col("total_trips")),
            }
        )
    )
    urgency = [-F.col("bunching_rate"), -F.col("gap_rate"), -F.col("mean_dwell_sec"), F.col("wow_trend")]
    per_type = pool.select(
        "*", F.posexplode(F.array(*[scoring.rank_key(u) for u in urgency])).alias("type_no", "type_key")
    )
    order = ["type_key", scoring.rank_key(F.col("reliability_score")), "route_id", "stop_id"]
    in_route = F.row_number().over(Window.partitionBy("type_no", "route_id").orderBy(*order))
    in_type = F.row_number().over(Window.partitionBy("type_no").orderBy(*order))
    return (
        per_type.withColumn("in_route", in_route)
        .where(F.col("in_route") == 1)
        .withColumn("place", in_type)
        .where(F.col("place") <= cfg.n_cards)
    )


def decision_cards(segments: DataFrame, routes: DataFrame, cfg: ReliabilityConfig = DEFAULTS) -> DataFrame:
    """Card i goes to the most urgent route of type i mod 4 that has no card yet."""
    cards = _candidates(segments, routes, cfg).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "type_no",
                    "place",
                    "route_id",
                    "stop_id",
                    "reliability_score",
                    "total_trips",
                    "bunching_rate",
                    "gap_rate",
                    "mean_dwell_sec",
                    "route_base_boardings",
                    "wow_trend",
                )
            )
        ).alias("queue")
    )
    queue = F.col("queue")

    def pick(chosen: Column, turn: Column) -> Column:
        def free(card: Column) -> Column:
            taken = F.exists(chosen, lambda c: c["route_id"] == card["route_id"])
            return (card["type_no"] == turn % len(CARD_TYPES)) & ~taken

        best = F.slice(F.filter(queue, free), 1, 1)
        return F.concat(chosen, F.transform(best, lambda c: c.withField("place", turn + 1)))

    turns = F.sequence(F.lit(0), F.lit(cfg.n_cards - 1))
    names = F.array(*[F.lit(t) for t in CARD_TYPES])
    return (
        cards.select(F.explode(F.aggregate(turns, F.slice(queue, 1, 0), pick)).alias("card"))
        .select("card.*")
        .select(
            F.col("place").alias("card_no"),
            F.get(names, F.col("type_no")).alias("card_type"),
            "route_id",
            F.col("stop_id").alias("segment_id"),
            "reliability_score",
            "total_trips",
            "bunching_rate",
            "gap_rate",
            "mean_dwell_sec",
            "route_base_boardings",
            "wow_trend",
        )
    )


def peak_band(events: DataFrame) -> DataFrame:
    """Per route, the peak band in which most of its gap events fall."""
    hour = clock.hour_fraction(F.col("timestamp"))
    in_band = F.when(hour.between(8.0, 10.0), "8-10 AM peak band").when(hour.between(17.0, 19.0), "5-7 PM peak band")
    per_band = (
        events.where(F.col("is_gap") & in_band.isNotNull())
        .groupBy("route_id", in_band.alias("band"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_band.groupBy("route_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "band")).alias("top")).select(
        "route_id", "top.band"
    )


def decision_text(
    cards: DataFrame,
    segments: DataFrame,
    events: DataFrame,
    schedule: DataFrame,
    cfg: ReliabilityConfig = DEFAULTS,
) -> DataFrame:
    """Cards as text. Schedule, peak band and network dwell come from the data."""
    detail = (
        cards.join(schedule, "route_id", "left")
        .join(peak_band(events), "route_id", "left")
        .withColumn("network_dwell", quantiles.median(segments, "mean_dwell_sec").scalar())
    )
    kind = F.col("card_type")
    boardings = F.col("route_base_boardings")
    known_boardings = F.when(boardings.isNull() | (boardings == 0), cfg.default_boardings).otherwise(boardings)
    trend, dwell = F.col("wow_trend"), text.fixed(F.col("mean_dwell_sec"), 1)

    def words(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    # The card texts.
    reason = (
        F.when(kind == "bunching", words(
            "Severe bus bunching: segment bunching rate is ", text.fixed(F.col("bunching_rate") * 100, 1), "%."))
        .when(kind == "gap", words(
            "Recurring service gaps: segment gap rate is ", text.fixed(F.col("gap_rate") * 100, 1), "%."))
        .when(kind == "dwell", words("Extended dwell congestion: avg dwell is ", dwell, "s."))
        .otherwise(words("Operational drop: Route WoW trend is ", text.fixed(trend, 1), " pts."))
    )
    action = (
        F.when(kind == "bunching", words(
            "Introduce holding point at stop ", F.col("segment_id"), ", target headway ",
            text.fixed(F.col("scheduled_min"), 1), " min."))
        .when(kind == "gap", words(
            "Add 1 trip in the [", F.coalesce("band", F.lit("peak band")), "] on Route ", F.col("route_id"), "."))
        .when(kind == "dwell", words(
            "Deploy pre-board validation at stop ", F.col("segment_id"), " (avg dwell ", dwell,
            "s vs network median ", text.fixed(F.col("network_dwell"), 1), "s)."))
        .otherwise(words(
            "Flag Route ", F.col("route_id"), " for depot review: score fell ", text.fixed(F.abs(trend), 1), " pts."))
    )
    severe = (kind == "bunching") | ((kind == "WoW-degrading") & (trend < SEVERE_DROP))
    return detail.select(
        "card_no",
        "route_id",
        "segment_id",
        F.round("reliability_score", 1).alias("reliability_score"),
        F.when(severe, "severe").otherwise("warning").alias("severity"),
        reason.alias("reason"),
        action.alias("recommended_action"),
        words("affects ~", text.thousands(known_boardings * cfg.affected_share), " daily boardings").alias(
            "rider_impact"
        ),
    ).orderBy("card_no")
