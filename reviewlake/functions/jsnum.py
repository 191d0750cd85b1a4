"""Scalar conventions shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column) -> Column:
    """Round half towards +infinity, so -2.5 becomes -2."""
    return F.floor(value + F.lit(0.5))


def round_micro(value: Column) -> Column:
    """Round to six decimals with the same rule."""
    return half_up(value * F.lit(1_000_000.0)) / F.lit(1_000_000.0)


def is_blank(value: Column) -> Column:
    """True for NULL and for the empty string."""
    return F.coalesce(value, F.lit("")) == ""


def exact_sum(value: Column) -> Column:
    """Order-independent money sum: add decimals, return a double (0 when there are no rows)."""
    return F.coalesce(F.sum(value.cast("decimal(18,6)")).cast("double"), F.lit(0.0))


def total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0))


def share_pct(part: Column, whole: Column) -> Column:
    """Whole-number percentage; a zero denominator counts as one."""
    return half_up(part / F.greatest(whole, F.lit(1)) * 100)
