"""Mood against events: the divergence index, the flag, and state completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.numbers import clip
from terrace.operators.minutes import by_minute, filled
from terrace.schemas import EMOTION_COLUMNS

THRESHOLD = 0.65


def arbitrage_index(panic: Column, stability: Column) -> Column:
    return F.abs(clip(panic, -1.0, 1.0)) * (1.0 - clip(stability, 0.0, 1.0))


def select_moments(social: DataFrame, match: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Full join by minute, forward fill, index and flag."""
    merged = social.join(match, ["fixture_id", "minute"], "full")
    ready = merged.withColumns(
        {c: F.coalesce(filled(F.col(c)), F.lit(0.0)) for c in ("crowd_panic_score", "rolling_xg", "delta_xg_10min")}
    )
    indexed = ready.withColumn(
        "arbitrage_index", arbitrage_index(F.col("crowd_panic_score"), F.col("delta_xg_10min"))
    )
    return indexed.withColumn("flagged", F.col("arbitrage_index") >= threshold)


def fill_mood(state: DataFrame) -> DataFrame:
    """Carry mood over minutes the chat did not cover; defaults before the first."""
    defaults = {c: F.lit(0.0) for c in (*EMOTION_COLUMNS, "emotional_volatility")}
    defaults["dominant_emotion"] = F.lit("neutral")
    defaults["comment_volume"] = F.lit(0).cast("bigint")
    return state.withColumns(
        {c: F.coalesce(filled(F.col(c)), d) for c, d in defaults.items() if c in state.columns}
    )


def flagged_by_index(state: DataFrame, top: int | None = None) -> DataFrame:
    """Flagged minutes ranked by index inside the fixture, optionally the top few."""
    order = Window.partitionBy("fixture_id").orderBy(F.desc("arbitrage_index"), "minute")
    ranked = state.filter("flagged").withColumn("position", F.row_number().over(order))
    return ranked if top is None else ranked.filter(F.col("position") <= top)


def flag_counts(state: DataFrame) -> DataFrame:
    return state.groupBy("fixture_id").agg(F.sum(F.col("flagged").cast("bigint")).alias("flagged_minutes"))


def minute_change(state: DataFrame, columns: tuple[str, ...] = ("crowd_panic_score", "delta_xg_10min", "arbitrage_index")) -> DataFrame:
    """Last minute of each fixture with its change against the minute before."""
    order = by_minute()
    changed = state.withColumns(
        {f"{c}_change": F.coalesce(F.col(c) - F.lag(c).over(order), F.lit(0.0)) for c in columns}
    )
    last = changed.withColumn("_next", F.lead("minute").over(order)).filter(F.col("_next").isNull())
    return last.select("fixture_id", "minute", *columns, *[f"{c}_change" for c in columns])
