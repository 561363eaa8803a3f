"""headwise: transit reliability analytics as Spark DataFrame jobs."""

from headwise.config import DEFAULTS, ReliabilityConfig

__all__ = ["DEFAULTS", "ReliabilityConfig"]
