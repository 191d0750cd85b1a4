"""Severity levels, weights and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity order and score deduction per finding.
SEVERITIES = ("critical", "high", "medium", "low", "info")
DEDUCTION = {"critical": 25, "high": 15, "medium": 10, "low": 5, "info": 2}

# Editor diagnostic level per severity (anything else is a warning).
EDITOR_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "information", "info": "hint"}

# SARIF level per severity; the command line variant knows two levels only.
SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}

# Report icon per severity (anything else gets the info icon).
ICON = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🔵"}
INFO_ICON = "ℹ️"


def lookup(value: Column, table: dict, default) -> Column:
    """Small constant table as one CASE expression."""
    out = None
    for key, result in table.items():
        out = F.when(value == key, result) if out is None else out.when(value == key, result)
    return out.otherwise(default)


def deduction(severity: Column) -> Column:
    return lookup(severity, DEDUCTION, 0)


def severity_rank(severity: Column) -> Column:
    """0 for critical up to 4 for info; unknown severities sort first (-1)."""
    return lookup(severity, {s: i for i, s in enumerate(SEVERITIES)}, -1)


def sarif_level(severity: Column, cli: bool = False) -> Column:
    if cli:
        return F.when(severity.isin("critical", "high"), "error").otherwise("warning")
    return lookup(severity, SARIF_LEVEL, "none")


def editor_level(severity: Column) -> Column:
    return lookup(severity, EDITOR_LEVEL, "warning")


def icon(severity: Column) -> Column:
    return lookup(severity, ICON, INFO_ICON)


def clamp_score(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def score_band(score: Column) -> Column:
    """Scores: good from 80, warn from 60."""
    return F.when(score >= 80, "good").when(score >= 60, "warn").otherwise("bad")


def precision_band(precision: Column) -> Column:
    """Precision as a rounded percentage: good from 80, warn from 50; NULL stays NULL."""
    pct = F.floor(precision * 100 + 0.5)
    return F.when(precision.isNull(), None).when(pct >= 80, "good").when(pct >= 50, "warn").otherwise("bad")


def rate_band(rate: Column) -> Column:
    return F.when(rate >= 80, "good").otherwise("bad")


def count_severities(column: str = "severity") -> list[Column]:
    """The five conditional counts, to be used inside one ``agg``."""
    return [F.count_if(F.col(column) == s).alias(f"{s}_count") for s in SEVERITIES]
