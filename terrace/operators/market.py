"""Bookmaker consensus, fair probabilities and their gap to the mood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.numbers import exact_round
from terrace.functions.text import strip
from terrace.operators.containment import anchor, grams

DRAW = "Draw"


def consensus_prices(odds: DataFrame) -> DataFrame:
    """Mean price per event and outcome; keeps the first feed position for ties."""
    return odds.groupBy("event_id", "outcome").agg(
        F.avg("price").alias("price"), F.min("feed_order").alias("outcome_order")
    )


def implied_probabilities(prices: DataFrame) -> DataFrame:
    """Inverse prices scaled to sum to 1 inside the event; non-positive prices dropped.

    An event has a handful of outcomes after the consensus, so the window is
    small whatever the number of bookmakers.
    """
    event = Window.partitionBy("event_id")
    raw = prices.filter(F.col("price") > 0).withColumn("_raw", 1.0 / F.col("price"))
    return raw.withColumn("probability", exact_round(F.col("_raw") / F.sum("_raw").over(event), 4)).drop("_raw")


def market_rows(probabilities: DataFrame, events: DataFrame) -> DataFrame:
    """One row per event: home, draw and away probability, favourite and certainty.

    ``events`` is (event_id, home_team, away_team).
    """
    named = probabilities.join(events.select("event_id", "home_team", "away_team"), "event_id")

    def of(test: Column) -> Column:
        return F.max(F.when(test, F.col("probability")))

    return named.groupBy("event_id").agg(
        of(F.col("outcome") == F.col("home_team")).alias("home_prob"),
        of(F.col("outcome") == DRAW).alias("draw_prob"),
        of(F.col("outcome") == F.col("away_team")).alias("away_prob"),
        F.min_by("outcome", F.struct(-F.col("probability"), F.col("outcome_order"))).alias("favorite"),
        exact_round(F.max("probability"), 4).alias("certainty"),
    )


def match_events(fixtures: DataFrame, events: DataFrame) -> DataFrame:
    """First market event, in feed order, whose names contain both of a fixture's names.

    The containment test is blocked on an anchor of the fixture's first name and
    the short character runs of the event's names, so it is an equi-join over
    distinct name pairs instead of a product of the two tables.
    """
    pairs = (
        fixtures.select(
            strip(F.lower(F.coalesce("home_team", F.lit("")))).alias("_home"),
            strip(F.lower(F.coalesce("away_team", F.lit("")))).alias("_away"),
        )
        .distinct()
        .withColumn("_anchor", anchor(F.when(F.col("_home") != "", F.col("_home")).otherwise(F.col("_away"))))
        .filter(F.col("_anchor") != "")
    )
    blob = F.concat_ws(
        " ", F.lower(F.coalesce("home_team", F.lit(""))), F.lower(F.coalesce("away_team", F.lit("")))
    )
    blobs = events.groupBy(blob.alias("_blob")).agg(
        F.min_by("event_id", "feed_order").alias("event_id"), F.min("feed_order").alias("_feed")
    )
    cut = blobs.select("*", F.explode(grams(F.col("_blob"))).alias("_anchor"))
    held = pairs.join(
        cut,
        (pairs["_anchor"] == cut["_anchor"])
        & F.contains(cut["_blob"], pairs["_home"])
        & F.contains(cut["_blob"], pairs["_away"]),
    )
    first = held.groupBy("_home", "_away").agg(F.min_by("event_id", "_feed").alias("event_id"))
    keyed = fixtures.select(
        "fixture_id",
        strip(F.lower(F.coalesce("home_team", F.lit("")))).alias("_home"),
        strip(F.lower(F.coalesce("away_team", F.lit("")))).alias("_away"),
    )
    return keyed.join(first, ["_home", "_away"]).select("fixture_id", "event_id")


def divergence(panic: Column, certainty: Column) -> Column:
    return exact_round(F.abs(panic) * certainty, 4)
