"""Archive rows: validation, result rows, back-fill of old schemas, keyed merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.functions.numbers import clip
from terrace.functions.text import message_key, strip
from terrace.operators.cleaning import keep_first, keep_last
from terrace.schemas import ARCHIVE, EMOTION_COLUMNS, column_names

ARCHIVE_COLUMNS = column_names(ARCHIVE)

# Allowed range per numeric column; None is open.
RANGES: dict[str, tuple[float, float | None]] = {
    "crowd_panic_score": (-1.0, 1.0),
    "emotional_volatility": (0.0, 1.0),
    "delta_xg_10min": (0.0, 1.0),
    "arbitrage_index": (0.0, 1.0),
    **{c: (0.0, 1.0) for c in EMOTION_COLUMNS},
    "rolling_xg": (0.0, None),
    "comment_volume": (0.0, None),
    "situation_confidence": (0.0, 1.0),
}
TEXT_DEFAULTS = {"dominant_emotion": "neutral", "situation": "unknown"}


def _number(df: DataFrame, name: str) -> Column:
    none = F.lit(None).cast("double")
    return F.nanvl(F.col(name).try_cast("double"), none) if name in df.columns else none


def validate_state(state: DataFrame, archived_at: Column | None = None) -> DataFrame:
    """Coerce state rows to the archive schema: no NULLs, values in range, one row per minute.

    ``state`` carries ``fixture_id`` and ``ingest_seq``. The last row of a minute
    wins, and gaps are filled in input order, not minute order. De-duplication
    comes first, so the fill runs over at most one row per match minute.
    """
    minute = F.nanvl(F.col("minute").try_cast("double"), F.lit(None).cast("double")).try_cast("bigint")
    usable = state.withColumn("minute", minute).filter(F.col("minute").isNotNull())
    usable = usable.withColumn("minute", F.greatest("minute", F.lit(0)))
    unique = keep_last(usable, ["fixture_id", "minute"])
    so_far = (
        Window.partitionBy("fixture_id").orderBy("ingest_seq")
        .rowsBetween(Window.unboundedPreceding, 0)
    )

    def carried(col: Column, default: Column) -> Column:
        return F.coalesce(F.last(col, ignorenulls=True).over(so_far), default)

    columns: dict[str, Column] = {
        c: clip(carried(_number(unique, c), F.lit(0.0)), *bounds) for c, bounds in RANGES.items()
    }
    for name, default in TEXT_DEFAULTS.items():
        present = F.col(name).cast("string") if name in unique.columns else F.lit(None).cast("string")
        columns[name] = carried(present, F.lit(default))
    columns["comment_volume"] = columns["comment_volume"].cast("int")
    flagged = F.col("flagged").cast("boolean") if "flagged" in unique.columns else F.lit(None).cast("boolean")
    columns["flagged"] = F.coalesce(flagged, F.lit(False))
    columns["match_id"] = F.col("fixture_id")
    columns["minute"] = F.col("minute").cast("int")
    columns["archived_at"] = F.current_timestamp() if archived_at is None else archived_at
    return assert_archive(unique.select(*[columns[c].alias(c) for c in ARCHIVE_COLUMNS]))


def assert_archive(rows: DataFrame) -> DataFrame:
    """Fail the job on a NULL or an out-of-range value (Parquet has no constraints)."""
    sound = F.lit(True)
    for name in ARCHIVE_COLUMNS:
        sound = sound & F.col(name).isNotNull()
    for name, (low, high) in RANGES.items():
        sound = sound & (F.col(name) >= low)
        if high is not None:
            sound = sound & (F.col(name) <= high)
    sound = sound & (F.col("minute") >= 0)
    return rows.filter(F.assert_true(sound, F.lit("archive row violates its constraints")).isNull())


def result_rows(fixtures: DataFrame, archived_at: Column | None = None) -> DataFrame:
    """One result row per fixture with defaults for what is missing."""
    def known(name: str, default: str) -> Column:
        return F.coalesce(F.when(F.col(name) != "", F.col(name)), F.lit(default)).alias(
            "final_score" if name == "score" else name
        )

    stamp = F.current_timestamp() if archived_at is None else archived_at
    return fixtures.select(
        F.col("fixture_id").alias("match_id"), known("home_team", "unknown"), known("away_team", "unknown"),
        "kickoff_utc", known("score", "0-0"), known("state", "post"), stamp.alias("archived_at"),
    )


def backfill_columns(prior: DataFrame) -> DataFrame:
    """Bring rows of an older schema to the archive columns."""
    fields = T.StructType.fromDDL(ARCHIVE)
    picked = [
        F.col(f.name) if f.name in prior.columns
        else F.lit("unknown" if f.name == "situation" else 0.0).cast(f.dataType).alias(f.name)
        for f in fields
    ]
    return prior.select(*picked)


def merge_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key is not replaced, plus the new rows."""
    kept = old.join(new.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new.select(*old.columns))


def stored_reactions(chat: DataFrame) -> DataFrame:
    """Keyed reactions: first of equal trimmed messages per fixture, blanks dropped."""
    keyed = chat.withColumn("message", strip(F.coalesce(F.col("message"), F.lit("")))).filter(F.col("message") != "")
    keyed = keyed.withColumn("message_hash", message_key(F.col("message")))
    kept = keep_first(keyed, ["fixture_id", "message_hash"])

    def text(name: str) -> Column:
        return (F.coalesce(F.col(name), F.lit("")) if name in kept.columns else F.lit("")).alias(name)

    return kept.select(
        F.col("fixture_id").alias("match_id"), "message_hash", "minute", "message",
        text("source"), text("team"), text("author"),
    )
