"""Numeric scores built from columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, percent: bool = False) -> Column:
    """``part / whole``, 0 when there is nothing to divide by."""
    value = F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
    return value * 100.0 if percent else value


def maintainability_clamped(complexity: Column, lines: Column) -> Column:
    raw = 171.0 - 5.2 * F.ln(complexity) - 0.23 * complexity - 16.2 * F.ln(lines)
    return F.when(lines == 0, F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))


def maintainability_volume(volume: Column, complexity: Column, lines: Column) -> Column:
    raw = 171.0 - 5.2 * F.ln(volume) - 0.23 * complexity - 16.2 * F.ln(lines)
    raw = F.when(volume == 0, F.lit(float("inf"))).otherwise(raw)
    return F.when((lines > 0) & (complexity > 0), raw).otherwise(F.lit(100.0))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
