"""Back-fill job: historic posts of all archived fixtures at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.operators import archive, attribution, cleaning
from terrace.operators.backfill import match_to_fixtures
from terrace.operators.minutes import posts_to_chat
from terrace.sources import tables


def backfill(posts: DataFrame, fixtures: DataFrame, texts: DataFrame | None = None, on: str = "doc_id") -> DataFrame:
    """Match, clean, tag, map to minutes and key the reactions, all that pass.

    Posts may come without their message; then ``texts`` has it, by ``on``.
    """
    matched = match_to_fixtures(posts, fixtures, texts, on)
    if texts is None:
        kept = cleaning.clean_reactions(matched, "terms").drop("terms")
    else:
        kept = cleaning.clean_keyed(matched, texts, on, "terms")
    chat = posts_to_chat(attribution.tag_teams(kept, fixtures), fixtures)
    return archive.stored_reactions(chat)


def run_backfill(posts: DataFrame, base: str) -> None:
    """Back-fill every fixture of the results table."""
    results = tables.load(posts.sparkSession, f"{base}/match_results", tables.MATCH_RESULTS)
    fixtures = results.withColumnRenamed("match_id", "fixture_id").select(
        "fixture_id", "home_team", "away_team", F.col("kickoff_utc")
    )
    tables.upsert(backfill(posts, fixtures), f"{base}/reactions", tables.REACTIONS)
