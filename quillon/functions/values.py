"""How missing values are kept: a number is DOUBLE, and missing is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing() -> Column:
    return F.lit(None).cast("double")


def number(c: Column) -> Column:
    """c as a DOUBLE with NaN as NULL."""
    return F.nanvl(c.cast("double"), missing())


def flag(condition: Column) -> Column:
    """1.0 if the condition holds; 0.0 if it doesn't, or is unknown."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def holds(condition: Column, unknown: bool = False) -> Column:
    return F.coalesce(condition, F.lit(unknown))


def no_nan(c: Column) -> Column:
    return F.nanvl(c, missing())
