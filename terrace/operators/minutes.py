"""The minute axis: mapping posts to minutes, dense calendars and forward fill.

A fixture has about a hundred minutes, so every window here runs over rows that
have already been aggregated to one per (fixture, minute).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

LEAD_IN_MINUTES = 15
MAX_MINUTE = 130
# A larger minute is a misread one; it would stretch its fixture's dense minutes.
LAST_POSSIBLE = 1000


def possible(minute: Column) -> Column:
    return F.coalesce((minute >= 0) & (minute <= LAST_POSSIBLE), F.lit(False))


def minute_fault(minute: Column) -> Column:
    """Why a minute cannot be placed on the axis, NULL where it can."""
    return F.when(minute.isNull(), "no minute").when(minute < 0, "negative minute").when(~possible(minute), "impossible minute")


def set_aside(per_minute: DataFrame) -> DataFrame:
    """Rows that ``densify`` leaves out, with their ``reason``."""
    return per_minute.withColumn("reason", minute_fault(F.col("minute"))).filter(F.col("reason").isNotNull())


def by_minute() -> WindowSpec:
    return Window.partitionBy("fixture_id").orderBy("minute")


def last_rows(k: int) -> WindowSpec:
    """The current row and the k-1 before it."""
    return by_minute().rowsBetween(-(k - 1), 0)


def filled(col: Column) -> Column:
    """Last known value up to this minute."""
    return F.last(col, ignorenulls=True).over(by_minute().rowsBetween(Window.unboundedPreceding, 0))


def minute_of(created: Column, kickoff: Column, max_minute: int = MAX_MINUTE) -> Column:
    elapsed = F.floor((F.unix_micros(created) - F.unix_micros(kickoff)) / F.lit(60_000_000))
    return F.least(F.greatest(elapsed, F.lit(0)), F.lit(max_minute)).cast("bigint")


def posts_to_chat(posts: DataFrame, fixtures: DataFrame, max_minute: int = MAX_MINUTE) -> DataFrame:
    """Give every post its match minute; posts before the lead-in or without a time go."""
    timed = posts.join(fixtures.select("fixture_id", "kickoff_utc"), "fixture_id")
    lead_in = F.col("kickoff_utc") - F.expr(f"INTERVAL {LEAD_IN_MINUTES} MINUTES")
    kept = timed.filter(F.col("created_utc") >= lead_in)
    return kept.withColumn(
        "minute", minute_of(F.col("created_utc"), F.col("kickoff_utc"), max_minute)
    ).drop("kickoff_utc")


def densify(per_minute: DataFrame, carry: dict[str, Column], empty: dict[str, Column]) -> DataFrame:
    """One row for every minute from 0 to the fixture's last, in a single pass.

    Each row is stretched up to the minute before the next row; the first row
    is also stretched back to 0. ``empty`` gives the value of a column in the
    minutes before the first row, ``carry`` its value in the minutes after a
    row (the row's own value for a forward fill, a constant for a zero fill).
    No calendar table and no second read of the input. Minutes no match can have
    are left out, so a misread stamp neither ends the job nor floods a task;
    ``set_aside`` gives those rows and why.
    """
    order = by_minute()
    spans = per_minute.filter(possible(F.col("minute"))).select(
        "*",
        F.coalesce(F.lead("minute").over(order) - 1, F.col("minute")).alias("_until"),
        F.when(F.lag("minute").over(order).isNull(), F.lit(0)).otherwise(F.col("minute")).alias("_from"),
    )
    rows = spans.withColumn("_m", F.explode(F.sequence(F.col("_from"), F.col("_until"))))
    picked = [
        F.when(F.col("_m") < F.col("minute"), empty[name])
        .when(F.col("_m") > F.col("minute"), after)
        .otherwise(F.col(name))
        .alias(name)
        for name, after in carry.items()
    ]
    return rows.select("fixture_id", F.col("_m").cast("bigint").alias("minute"), *picked)


def forward_filled(per_minute: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Dense minutes, each gap holding the values of the row before it."""
    return densify(per_minute, {c: F.col(c) for c in defaults}, defaults)


def zero_filled(per_minute: DataFrame, columns: list[str]) -> DataFrame:
    """Dense minutes, gaps holding 0."""
    zeros = {c: F.lit(0.0) for c in columns}
    return densify(per_minute, zeros, zeros)


def latest(df: DataFrame, keys: tuple[str, ...] = ("fixture_id",)) -> DataFrame:
    """Row of the last minute per fixture."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("minute")).alias("_row"))
    return last.select(*keys, "_row.*").select(*df.columns)
