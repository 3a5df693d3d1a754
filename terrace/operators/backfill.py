"""Historic reactions matched to fixtures by time window and team term."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEFORE_MINUTES = 15
AFTER_MINUTES = 130
BUCKET_SECONDS = 3600


def with_windows(fixtures: DataFrame) -> DataFrame:
    """Capture window, team terms and the hour buckets the window touches."""
    start = F.col("kickoff_utc") - F.expr(f"INTERVAL {BEFORE_MINUTES} MINUTES")
    end = F.col("kickoff_utc") + F.expr(f"INTERVAL {AFTER_MINUTES} MINUTES")
    terms = F.filter(
        F.array(F.coalesce("home_team", F.lit("")), F.coalesce("away_team", F.lit(""))),
        lambda t: ~t.isin("", "unknown"),
    )
    return fixtures.withColumns({
        "_from": start, "_to": end, "terms": terms,
        "_bucket": F.sequence(
            F.floor(F.unix_seconds(start) / BUCKET_SECONDS), F.floor(F.unix_seconds(end) / BUCKET_SECONDS)
        ),
    }).filter(F.size("terms") > 0)


def match_to_fixtures(posts: DataFrame, fixtures: DataFrame, texts: DataFrame | None = None, on: str = "doc_id") -> DataFrame:
    """Posts inside a fixture's window that name one of its teams.

    Posts may come without their message: then ``texts`` has it, by ``on``, and
    joins behind the windows, so that no message moves with the hours.

    A range join turned into an equi-join on the hour: a window touches at most
    four hours, a post exactly one. A crowded hour is split by the skew-join
    rule; fixtures are broadcast only when their measured size allows it.
    """
    windows = with_windows(fixtures).select(
        "fixture_id", "terms", "_from", "_to", F.explode("_bucket").alias("_bucket")
    )
    keyed = posts.withColumn("_bucket", F.floor(F.unix_seconds("created_utc") / BUCKET_SECONDS))
    joined = keyed.join(windows, "_bucket").filter(
        (F.col("created_utc") >= F.col("_from")) & (F.col("created_utc") <= F.col("_to"))
    )
    if texts is not None:
        joined = joined.drop("_bucket", "_from", "_to").join(texts, on)
    low = F.lower(F.coalesce("message", F.lit("")))
    named = F.exists("terms", lambda t: F.contains(F.col("_low"), F.lower(t)))
    return joined.withColumn("_low", low).filter(named).drop("_bucket", "_from", "_to", "_low")
