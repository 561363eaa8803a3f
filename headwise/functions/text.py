"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """Number with a set count of decimals, rounded before it is printed."""
    return F.format_string(f"%.{digits}f", F.round(value, digits) + F.lit(0.0))


def signed(value: Column, digits: int) -> Column:
    return F.concat(F.when(value >= 0, "+").otherwise(""), fixed(value, digits))


def thousands(value: Column) -> Column:
    return F.format_string("%,d", value.cast("bigint"))


def human_count(value: Column) -> Column:
    """1.2M, 34K or the plain number with separators."""
    return (
        F.when(value >= 1_000_000, F.concat(fixed(value / F.lit(1e6), 1), F.lit("M")))
        .when(value >= 1_000, F.concat(fixed(value / F.lit(1e3), 0), F.lit("K")))
        .otherwise(thousands(value))
    )


def route_number(route_id: Column) -> Column:
    return F.regexp_extract(route_id, r"(\d+)$", 1).try_cast("int")


def question_key(question: Column) -> Column:
    """Case, question marks and full stops do not matter when looking up an answer."""
    return F.trim(F.regexp_replace(F.lower(question), "[?.]", ""))
