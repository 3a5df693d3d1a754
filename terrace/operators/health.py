"""Run health, freshness, capture phase and the choice of fixture to capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STALE_MINUTES = 25
GRACE_MINUTES = 15
MATCH_MINUTES = 180

# Meaning of a fixture id prefix.
PREFIX_SOURCES = {"ESPN": "live", "FEED": "feed", "SIM": "simulator"}


def fixture_source(fixture_id: Column) -> Column:
    prefix = F.get(F.split(fixture_id, "-", 2), F.lit(0))
    chain = None
    for key, name in PREFIX_SOURCES.items():
        chain = F.when(prefix == key, name) if chain is None else chain.when(prefix == key, name)
    return chain.otherwise("unknown")


def source_counts(chat: DataFrame) -> DataFrame:
    return chat.groupBy("fixture_id", "source").agg(F.count(F.lit(1)).alias("n"))


def run_health(chat: DataFrame, commentary: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """One heartbeat row per fixture of ``runs`` (fixture_id)."""
    lines = commentary.groupBy("fixture_id").agg(F.count(F.lit(1)).alias("n_commentary"))
    return status_rows(source_counts(chat), lines, runs, as_of)


def status_rows(source_counts: DataFrame, lines: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """Heartbeat rows from counts by (fixture_id, source) and of lines by fixture_id.

    The per-source map lists the largest source first.
    """
    counts = source_counts.groupBy("fixture_id").agg(
        F.sum("n").alias("n_reactions"),
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "source", "n"))).alias("_c"),
    )
    joined = runs.select("fixture_id").join(counts, "fixture_id", "left").join(lines, "fixture_id", "left")
    entries = F.transform(F.coalesce("_c", F.array()), lambda c: F.struct(c["source"].alias("key"), c["n"].alias("value")))
    zero = F.lit(0).cast("bigint")
    source = fixture_source(F.col("fixture_id"))
    n_lines = F.coalesce("n_commentary", zero)
    return joined.select(
        F.col("fixture_id").alias("match_id"),
        F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("last_run_utc"),
        source.alias("source"), (source == "live").alias("live"),
        F.coalesce("n_reactions", zero).alias("n_reactions"), n_lines.alias("n_commentary"),
        F.map_from_entries(entries).alias("reactions_by_source"),
        ((source == "live") & (n_lines > 0)).alias("fetch_ok"),
    )


def freshness(status: DataFrame, as_of: Column, stale_minutes: int = STALE_MINUTES) -> DataFrame:
    """Level, label and detail per heartbeat row."""
    stamp = F.col("last_run_utc").try_cast("timestamp")
    age = (F.unix_micros(as_of) - F.unix_micros(stamp)) / F.lit(60_000_000)
    age_text = F.when(age.isNull(), "unknown age").otherwise(
        F.concat(age.cast("bigint").cast("string"), F.lit(" min ago"))
    )
    parts = F.transform(
        F.map_entries("reactions_by_source"), lambda e: F.concat(e["key"], F.lit(" "), e["value"].cast("string"))
    )
    listed = F.coalesce(F.array_join(parts, ", "), F.lit(""))
    sources = F.when(listed == "", "no sources").otherwise(listed)
    none = F.coalesce("n_reactions", F.lit(0).cast("bigint")) == 0
    fallback = ~F.coalesce("live", F.lit(False))
    stale = F.coalesce(age > stale_minutes, F.lit(False))

    def pick(empty: str, degraded: Column | str, late: Column | str, fresh: Column | str) -> Column:
        as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
        return (
            F.when(none, F.lit(empty)).when(fallback, as_col(degraded))
            .when(stale, as_col(late)).otherwise(as_col(fresh))
        )

    return status.select(
        "match_id",
        pick("no-data", "degraded", "stale", "live").alias("level"),
        pick("No data", "Demo / fallback data", "Stale", "Live capture").alias("label"),
        pick(
            "No captured engine state yet.",
            F.concat(F.lit("No live match captured — showing "), F.coalesce("source", F.lit("fallback")),
                     F.lit(" data ("), age_text, F.lit(").")),
            F.concat(F.lit("Last live capture "), age_text,
                     F.lit(" — between matches or the feed is delayed.")),
            F.concat(F.col("n_reactions").cast("string"), F.lit(" reactions ("), sources,
                     F.lit("); updated "), age_text, F.lit(".")),
        ).alias("detail"),
    )


def capture_phase(state: Column, kickoff: Column, as_of: Column, post_first_seen: Column) -> Column:
    """pre, live, post-window or frozen."""
    grace_over = as_of >= post_first_seen + F.expr(f"INTERVAL {GRACE_MINUTES} MINUTES")
    long_over = as_of >= kickoff + F.expr(f"INTERVAL {MATCH_MINUTES} MINUTES")
    return (
        F.when(state == "pre", "pre").when(state == "in", "live")
        .when(F.coalesce(grace_over, F.lit(False)) | F.coalesce(long_over, F.lit(False)), "frozen")
        .otherwise("post-window")
    )


def capture_pick(board: DataFrame, as_of: Column) -> DataFrame:
    """Fixture to capture: first in progress, else first finished inside its window."""
    recent = (F.col("state") == "post") & (as_of < F.col("kickoff_utc") + F.expr(f"INTERVAL {MATCH_MINUTES} MINUTES"))
    rank = F.when(F.col("state") == "in", 0).when(recent, 1)
    ranked = board.withColumn("_rank", rank).filter(F.col("_rank").isNotNull())
    rest = [c for c in board.columns if c != "feed_order"]
    best = ranked.agg(F.min_by(F.struct(*rest), F.struct("_rank", "feed_order")).alias("b"))
    return best.filter(F.col("b").isNotNull()).select("b.*")


def live_pick(board: DataFrame) -> DataFrame:
    """First fixture in progress, if any."""
    rest = [c for c in board.columns if c != "feed_order"]
    best = board.filter(F.col("state") == "in").agg(F.min_by(F.struct(*rest), F.col("feed_order")).alias("b"))
    return best.filter(F.col("b").isNotNull()).select("b.*")
