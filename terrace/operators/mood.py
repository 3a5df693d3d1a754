"""Mood: shares, minute profiles, panic, dominant emotion and volatility."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.lexicon import EMOTION_TERMS, PANIC_TERMS, Lexicon, emotion_intensities, panic_score
from terrace.functions.numbers import clip, first_max, half_even
from terrace.operators.minutes import by_minute, forward_filled, last_rows
from terrace.schemas import EMOTION_COLUMNS, EMOTIONS

MOOD_WINDOW = 5


def total_intensity() -> Column:
    return sum((F.col(c) for c in EMOTION_COLUMNS[1:]), F.col(EMOTION_COLUMNS[0]))


def emotion_shares(scored: DataFrame) -> DataFrame:
    """Replace intensities by their share of the row's total; silent rows stay 0."""
    total = total_intensity()
    shares = {c: F.when(F.col("_total") > 0, F.col(c) / F.col("_total")).otherwise(0.0) for c in EMOTION_COLUMNS}
    return scored.withColumn("_total", total).withColumns(shares).drop("_total")


def dominant_emotion(silent: str = "neutral") -> Column:
    """First maximum in fixed order, ``neutral`` when nothing fired."""
    values = F.array(*EMOTION_COLUMNS)
    names = F.array(*[F.lit(e) for e in EMOTIONS])
    return F.when(F.array_max(values) <= 0, F.lit(silent)).otherwise(
        F.element_at(names, first_max(values).cast("int"))
    )


def mood_balance() -> Column:
    """Weighted negative minus positive shares; surprise has no direction."""
    negative = 1.2 * F.col("emo_panic") + 1.1 * F.col("emo_despair") + 0.6 * F.col("emo_anger")
    return negative - (F.col("emo_confidence") + 0.9 * F.col("emo_joy"))


def panic_from_shares() -> Column:
    return F.tanh(2.0 * mood_balance())


def minute_means(shared: DataFrame, columns: list[str] = EMOTION_COLUMNS) -> DataFrame:
    """Mean per minute and row count; both combine before the shuffle."""
    return shared.groupBy("fixture_id", "minute").agg(
        *[F.avg(c).alias(c) for c in columns], F.count(F.lit(1)).alias("comment_volume")
    )


def dense_profile(means: DataFrame, columns: list[str] = EMOTION_COLUMNS) -> DataFrame:
    """Dense minutes; gaps repeat the previous profile, its volume included."""
    defaults = {c: F.lit(0.0) for c in columns}
    return forward_filled(means, {**defaults, "comment_volume": F.lit(0).cast("bigint")})


def minute_profile(chat: DataFrame, lexicon: Lexicon = EMOTION_TERMS) -> DataFrame:
    return dense_profile(minute_means(emotion_shares(emotion_intensities(chat, "message", lexicon))))


def with_volatility(profile: DataFrame, window: int = MOOD_WINDOW) -> DataFrame:
    """Half the L1 distance to the minute before, averaged over ``window`` rows."""
    order = by_minute()
    moved = sum((F.abs(F.col(c) - F.lag(c).over(order)) for c in EMOTION_COLUMNS), F.lit(0.0))
    stepped = profile.withColumn("_step", F.coalesce(moved / 2, F.lit(0.0)))
    smooth = clip(F.avg("_step").over(last_rows(window)), 0.0, 1.0)
    return stepped.withColumn("emotional_volatility", smooth).drop("_step")


def rolling_panic(series: DataFrame, column: str, window: int = MOOD_WINDOW) -> DataFrame:
    smooth = clip(F.avg(column).over(last_rows(window)), -1.0, 1.0)
    return series.withColumn("crowd_panic_score", smooth)


def series_from_profile(profile: DataFrame, window: int = MOOD_WINDOW) -> DataFrame:
    """Smoothed panic, dominant emotion and volatility on a dense profile."""
    scored = rolling_panic(profile.withColumn("_panic", panic_from_shares()), "_panic", window)
    labelled = scored.withColumn("dominant_emotion", dominant_emotion())
    return with_volatility(labelled).select(
        "fixture_id", "minute", "crowd_panic_score", *EMOTION_COLUMNS, "comment_volume",
        "dominant_emotion", "emotional_volatility",
    )


def series_from_scores(scored: DataFrame, window: int = MOOD_WINDOW) -> DataFrame:
    """``emotion_series`` of rows that carry their intensities instead of a message."""
    return series_from_profile(dense_profile(minute_means(emotion_shares(scored))), window)


def emotion_series(chat: DataFrame, lexicon: Lexicon = EMOTION_TERMS, window: int = MOOD_WINDOW) -> DataFrame:
    """Per-minute mood series from messages."""
    return series_from_profile(minute_profile(chat, lexicon), window)


def simple_series(
    chat: DataFrame, terms: Mapping[str, float] = PANIC_TERMS, window: int = MOOD_WINDOW
) -> DataFrame:
    """Per-minute panic from the signed lexicon: tanh per post, mean, fill, smooth."""
    return simple_series_from_scores(panic_score(chat, "message", terms), window)


def simple_series_from_scores(scored: DataFrame, window: int = MOOD_WINDOW) -> DataFrame:
    means = scored.groupBy("fixture_id", "minute").agg(F.avg("panic").alias("panic"))
    dense = forward_filled(means, {"panic": F.lit(0.0)})
    return rolling_panic(dense, "panic", window).select("fixture_id", "minute", "crowd_panic_score")


def scored_share(scored: DataFrame, keys: tuple[str, ...] = ("fixture_id",)) -> DataFrame:
    """Share of messages with at least one lexicon hit."""
    hit = F.when(total_intensity() > 0, 1.0).otherwise(0.0)
    return scored.groupBy(*keys).agg(half_even(F.avg(hit), 4).alias("coverage"))
