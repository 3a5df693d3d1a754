"""Ingest job: raw reactions and play-by-play of many fixtures to scored, stored state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.lexicon import EMOTION_TERMS, Lexicon, emotion_intensities
from terrace.operators import archive, attribution, cleaning, health, mood, selector, situation, threat
from terrace.operators.minutes import posts_to_chat
from terrace.session import cut_lineage, written
from terrace.sources import tables


@dataclass
class Captured:
    """Frames of one ingest pass; all are materialised, everything reads them."""

    chat: DataFrame
    lines: DataFrame
    events: DataFrame
    state: DataFrame


def named(merged: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Rows of known fixtures with their team names in ``_terms``."""
    names = F.filter(
        F.array(F.coalesce("home_team", F.lit("")), F.coalesce("away_team", F.lit(""))), lambda t: t != ""
    )
    return merged.join(fixtures.select("fixture_id", names.alias("_terms")), "fixture_id")


def gather_reactions(merged: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Clean against the fixture's team names and tag the sides of all that stay."""
    kept = cleaning.clean_reactions(named(merged, fixtures), "_terms").drop("_terms")
    return attribution.tag_teams(kept, fixtures)


def gather_posts(
    posts: DataFrame, texts: DataFrame, fixtures: DataFrame, lexicon: Lexicon, on: str = "doc_id",
) -> tuple[DataFrame, DataFrame]:
    """Chat and scored rows of posts whose messages are in ``texts``, by ``on``; each text is judged and scored once."""
    kept = cleaning.clean_posts(named(posts, fixtures), texts, on, "_terms")
    timed = written(posts_to_chat(kept, fixtures))
    scored = written(emotion_intensities(cleaning.kept_texts(texts, timed, on), "message", lexicon))
    told = timed.join(scored.select(on, "_text", "message"), [on, "_text"])
    tagged = attribution.tag_teams(told, fixtures)
    order = ["fixture_id", on, *[c for c in posts.columns if c not in ("fixture_id", on)], "message", "team", "minute"]
    moods = timed.select("fixture_id", "minute", on, "_text").join(scored.drop("message"), [on, "_text"])
    return written(tagged.select(*order)), moods


def flagged_state(social: DataFrame, match: DataFrame, threshold: float) -> DataFrame:
    """Mood and threat series joined, flagged, completed and classified."""
    return situation.classify(selector.fill_mood(selector.select_moments(social, match, threshold)))


def capture(
    merged: DataFrame, lines: DataFrame, fixtures: DataFrame, threshold: float = selector.THRESHOLD,
    lexicon: Lexicon = EMOTION_TERMS, texts: DataFrame | None = None, on: str = "doc_id",
) -> Captured:
    """Clean, tag, score and classify. ``merged`` may come without messages; then ``texts`` has them, by ``on``."""
    if texts is None:
        chat = cut_lineage(posts_to_chat(gather_reactions(merged, fixtures), fixtures))
        social = mood.emotion_series(chat, lexicon)
    else:
        chat, moods = gather_posts(merged, texts, fixtures, lexicon, on)
        social = mood.series_from_scores(moods)
    lines = written(lines)
    events = written(threat.parse_commentary(lines))
    state = cut_lineage(flagged_state(social, threat.rolling_threat(events), threshold))
    return Captured(chat, lines, events, state)


def store(captured: Captured, fixtures: DataFrame, base: str, as_of: Column | None = None) -> None:
    """Write the run tables, the archive, the results, the reactions and the heartbeats."""
    stamp = F.current_timestamp() if as_of is None else as_of
    tables.replace_tables({
        "raw_chat": captured.chat, "raw_commentary": captured.lines, "match_events": captured.events,
        "quarantine": threat.quarantined_lines(captured.lines)}, base)
    tables.export_sorted(captured.state, f"{base}/state", ["fixture_id", "minute"])
    rows = archive.validate_state(captured.state.withColumn("ingest_seq", F.col("minute")), stamp)
    tables.upsert(rows, f"{base}/match_archive", tables.MATCH_ARCHIVE)
    known = captured.state.select("fixture_id").distinct()
    results = archive.result_rows(fixtures.join(known, "fixture_id", "left_semi"), stamp)
    tables.upsert(results, f"{base}/match_results", tables.MATCH_RESULTS)
    tables.upsert(archive.stored_reactions(captured.chat), f"{base}/reactions", tables.REACTIONS)
    beats = health.run_health(captured.chat, captured.lines, known, stamp)
    tables.upsert(beats, f"{base}/run_status", tables.RUN_STATUS)
