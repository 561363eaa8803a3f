"""Thresholds, weights and scale settings, passed explicitly to every operator."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ReliabilityConfig:
    # They must equal the published scoring rules for results to match.
    bunching_threshold: float = 0.25  # headway below 25 % of schedule
    gap_threshold: float = 2.0  # headway above 200 % of schedule
    weight_cov: float = 0.40
    weight_bunching: float = 0.30
    weight_gap: float = 0.30
    rate_cap: float = 0.5  # a rate of 50 % already earns the full penalty
    wow_lag_rows: int = 7
    min_trips: int = 80  # support needed before a stop may get a decision card
    n_cards: int = 8
    affected_share: float = 0.12  # share of boardings a decision card claims
    report_share: float = 0.15  # share of boardings the route report claims
    default_boardings: int = 5000

    # A stop with more pings is sorted over several tasks.
    split_rows: int = 1_000_000


DEFAULTS = ReliabilityConfig()
