"""Landed match-detail payloads: team and player statistics, leaders, key events, odds.

Readers take (fixture_id, payload_order, payload); a fixture may land in any
number of payloads, list positions count on across them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace import schemas
from terrace.functions.text import strip

# Statistics kept per team and per player.
TEAM_STATS = [
    "possessionPct", "totalShots", "shotsOnTarget", "wonCorners", "saves", "foulsCommitted",
    "accuratePasses", "passPct", "totalTackles", "interceptions", "effectiveClearance",
    "blockedShots", "accurateCrosses",
]
PLAYER_STATS = [
    "totalGoals", "goalAssists", "totalShots", "shotsOnTarget", "saves", "shotsFaced",
    "goalsConceded", "foulsCommitted", "yellowCards", "redCards",
]


def _blank(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def _position(pos: str) -> Column:
    """Place of an entry: its payload, then its position in it. A struct, so no size makes two places alike."""
    return F.struct(F.col("payload_order").cast("bigint").alias("payload_order"), F.col(pos).alias("position"))


def team_stats(landed: DataFrame) -> DataFrame:
    """Long table fixture_id, team_order, team, stat, value (text as shown)."""
    teams = landed.select(
        "fixture_id", F.posexplode(F.from_json("payload", schemas.BOXSCORE)["boxscore"]["teams"]).alias("team_order", "t")
    )
    rows = teams.select(
        "fixture_id", "team_order", strip(_blank(F.col("t.team.displayName"))).alias("team"),
        F.explode("t.statistics").alias("s"),
    )
    return rows.filter((F.col("team") != "") & F.col("s.name").isin(TEAM_STATS)).select(
        "fixture_id", "team_order", "team", F.col("s.name").alias("stat"), _blank(F.col("s.displayValue")).alias("value")
    )


def player_stats(landed: DataFrame) -> DataFrame:
    """One row per player with any statistic; missing ones are 0."""
    sides = landed.select(
        "fixture_id", "payload_order",
        F.posexplode(F.from_json("payload", schemas.ROSTERS)["rosters"]).alias("team_order", "r"),
    )
    rows = sides.select(
        "fixture_id", "team_order", strip(_blank(F.col("r.team.displayName"))).alias("team"), "payload_order",
        F.posexplode("r.roster").alias("_pos", "p"),
    ).filter((F.col("team") != "") & (F.size("p.stats") > 0)).withColumn("roster_order", _position("_pos"))

    def value(name: str) -> Column:
        mine = F.filter("p.stats", lambda s: s["name"] == name)
        return F.coalesce(F.get(F.reverse(mine), F.lit(0))["value"], F.lit(0.0)).alias(name)

    return rows.select(
        "fixture_id", "team_order", "team", "roster_order", _blank(F.col("p.athlete.displayName")).alias("name"),
        _blank(F.col("p.position.abbreviation")).alias("position"),
        F.coalesce("p.starter", F.lit(False)).alias("starter"), *[value(s) for s in PLAYER_STATS],
    )


def leaders(landed: DataFrame) -> DataFrame:
    """First leader per team and category, as "Player (value)"."""
    blocks = landed.select(
        "fixture_id", F.explode(F.from_json("payload", schemas.LEADERS)["leaders"]).alias("b")
    )
    rows = blocks.select(
        "fixture_id", strip(_blank(F.col("b.team.displayName"))).alias("team"), F.explode("b.leaders").alias("c")
    )
    top = F.get("c.leaders", F.lit(0))
    player = _blank(top["athlete"]["displayName"])
    return rows.filter((F.col("team") != "") & (player != "")).select(
        "fixture_id", "team", _blank(F.col("c.name")).alias("category"),
        F.concat(player, F.lit(" ("), _blank(top["displayValue"]), F.lit(")")).alias("leader"),
    )


def key_events(landed: DataFrame) -> DataFrame:
    """Typed events with their minute (the clock counts seconds)."""
    rows = landed.select(
        "fixture_id", "payload_order",
        F.posexplode(F.from_json("payload", schemas.KEY_EVENTS)["keyEvents"]).alias("_pos", "k"),
    ).withColumn("event_order", _position("_pos"))
    kind = _blank(F.col("k.type.type"))
    return rows.filter(kind != "").select(
        "fixture_id", "event_order", F.floor(F.coalesce("k.clock.value", F.lit(0.0)) / 60).alias("minute"),
        kind.alias("type"), _blank(F.col("k.team.displayName")).alias("team"), _blank(F.col("k.text")).alias("text"),
    )


def odds(landed: DataFrame) -> DataFrame:
    """Head-to-head prices of every bookmaker (event_id, feed order, outcome, price)."""
    books = landed.select(
        "event_id", "payload_order",
        F.posexplode(F.from_json("payload", schemas.ODDS_EVENT)["bookmakers"]).alias("_pos", "b"),
    )
    markets = books.select("event_id", "payload_order", "_pos", F.posexplode("b.markets").alias("_m", "m")).filter(F.col("m.key") == "h2h")
    outcomes = markets.select("event_id", "payload_order", "_pos", "_m", F.posexplode("m.outcomes").alias("_o", "o"))
    order = F.struct(F.col("payload_order").cast("bigint").alias("payload_order"), F.col("_pos").alias("book"), F.col("_m").alias("market"), F.col("_o").alias("outcome"))
    return outcomes.filter((_blank(F.col("o.name")) != "") & (F.col("o.price") > 0)).select(
        "event_id", order.alias("feed_order"), F.col("o.name").alias("outcome"), F.col("o.price").alias("price")
    )


def odds_events(landed: DataFrame) -> DataFrame:
    """Names of the landed market events, payload order as feed order."""
    e = F.from_json("payload", schemas.ODDS_EVENT)
    return landed.select(
        "event_id", F.col("payload_order").alias("feed_order"), _blank(e["home_team"]).alias("home_team"), _blank(e["away_team"]).alias("away_team")
    )
