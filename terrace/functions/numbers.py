"""Numeric columns: clipping, half-even rounding, parsed numbers, array arg-max."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(col: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        col = F.greatest(col, F.lit(low))
    if high is not None:
        col = F.least(col, F.lit(high))
    return col


def half_even(col: Column, digits: int) -> Column:
    """Round by scaling, ties to even: how array libraries round."""
    scale = F.lit(10.0**digits)
    return F.rint(col * scale) / scale


def exact_round(col: Column, digits: int) -> Column:
    """Round the exact binary value, true ties to even: how scalar Python rounds.

    The scaled value is split into product and rounding error (error-free
    multiplication), so 0.37235 stored just below the tie goes down.
    """
    scale = F.lit(10.0**digits)
    big = col * F.lit(134217729.0)
    head = big - (big - col)
    product = col * scale
    error = (head * scale - product) + (col - head) * scale
    whole = F.floor(product).cast("double")
    off_tie = (product - whole - 0.5) + error
    up = F.when(off_tie > 0, 1.0).when(off_tie < 0, 0.0).otherwise(F.pmod(whole, F.lit(2.0)))
    return (whole + up) / scale


def digits_only(col: Column) -> Column:
    """Number left after dropping everything but digits and dots; NULL when none."""
    return F.regexp_replace(col, r"[^\p{Nd}.]", "").try_cast("double")


def first_max(values: Column) -> Column:
    """1-based position of the first maximum of an array."""
    return F.array_position(values, F.array_max(values))


def score_goals(score: Column) -> Column:
    """``2-1`` (hyphen, en or em dash) to struct(home, away); NULL when unparseable."""
    parts = F.split(F.coalesce(score, F.lit("")), "[-–—]", -1)
    home = F.trim(F.get(parts, F.lit(0))).try_cast("int")
    away = F.trim(F.get(parts, F.lit(1))).try_cast("int")
    return F.when(
        (F.size(parts) == 2) & home.isNotNull() & away.isNotNull(),
        F.struct(home.alias("home"), away.alias("away")),
    )
