"""Team and player statistics: shares, control, keepers, performers, goal lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.numbers import digits_only

# Weights of the control index.
CONTROL_WEIGHTS = {"possessionPct": 0.45, "shotsOnTarget": 0.35, "totalShots": 0.20}

# Leader categories in display order, with their labels.
PERFORMER_LABELS = {
    "totalShots": "shots",
    "accuratePasses": "passes",
    "defensiveInterventions": "defensive actions",
    "saves": "saves",
}
GOAL_TYPES = ["goal", "penalty--scored", "own-goal"]


def stat_shares(stats: DataFrame) -> DataFrame:
    """First team's share of each control statistic, NULL when not computable.

    ``stats`` is the long table (fixture_id, team_order, team, stat, value).
    A share needs exactly two teams, both with digits, and a positive sum.
    """
    aggregates = [F.countDistinct("team_order").alias("_teams")]
    shares = {}
    for i, stat in enumerate(CONTROL_WEIGHTS):
        mine = F.col("stat") == stat
        number = F.when(mine, digits_only(F.col("value")))
        aggregates += [
            F.count(number).alias(f"_n{i}"),
            F.sum(number).alias(f"_sum{i}"),
            F.min_by(number, F.when(mine, F.col("team_order"))).alias(f"_first{i}"),
        ]
        usable = (F.col("_teams") == 2) & (F.col(f"_n{i}") == 2) & (F.col(f"_sum{i}") != 0)
        shares[stat] = F.when(usable, F.col(f"_first{i}") / F.col(f"_sum{i}"))
    grouped = stats.groupBy("fixture_id").agg(*aggregates)
    return grouped.select("fixture_id", *[c.alias(s) for s, c in shares.items()])


def control_index(stats: DataFrame) -> DataFrame:
    """Weighted share over the statistics that are available; NULL when none is."""
    shares = stat_shares(stats)
    zero = F.lit(0.0)
    blend = sum((F.coalesce(w * F.col(s), zero) for s, w in CONTROL_WEIGHTS.items()), zero)
    weight = sum(
        (F.when(F.col(s).isNotNull(), w).otherwise(0.0) for s, w in CONTROL_WEIGHTS.items()), zero
    )
    return shares.select(
        "fixture_id", *CONTROL_WEIGHTS, F.when(weight > 0, blend / weight).alias("control_index")
    )


def stat_matrix(stats: DataFrame) -> DataFrame:
    """One row per statistic with the two teams' values side by side."""
    def value_of(order: int) -> Column:
        return F.max(F.when(F.col("team_order") == order, F.col("value")))

    return stats.groupBy("fixture_id", "stat").agg(
        value_of(0).alias("home_value"), value_of(1).alias("away_value")
    )


def keeper_load(players: DataFrame) -> DataFrame:
    """Busiest goalkeeper per team; the first listed wins a tie."""
    keepers = players.filter(F.col("position") == "G")
    row = F.struct(
        F.col("name").alias("keeper"), "saves", F.col("shotsFaced").alias("shots_faced"),
        F.col("goalsConceded").alias("conceded"),
    )
    best = keepers.groupBy("fixture_id", "team").agg(
        F.max_by(row, F.struct("saves", -F.col("roster_order.payload_order"), -F.col("roster_order.position"))).alias("_k"),
        F.min("team_order").alias("team_order"),
    )
    return best.select("fixture_id", "team", "team_order", "_k.*")


def busiest_keeper(keepers: DataFrame) -> DataFrame:
    """The fixture's keeper with most saves, home first on ties."""
    best = keepers.groupBy("fixture_id").agg(
        F.max_by(F.struct("keeper", "saves", "shots_faced"), F.struct("saves", -F.col("team_order"))).alias("_k")
    )
    return best.select("fixture_id", "_k.*")


def top_performers(leaders: DataFrame) -> DataFrame:
    """One readable line per team from the leader categories."""
    picked = [F.max(F.when(F.col("category") == c, F.col("leader"))).alias(c) for c in PERFORMER_LABELS]
    wide = leaders.groupBy("fixture_id", "team").agg(*picked)
    parts = [F.when(F.col(c).isNotNull(), F.concat(c, F.lit(f" {label}"))) for c, label in PERFORMER_LABELS.items()]
    line = F.concat_ws("; ", *parts)
    return wide.select("fixture_id", "team", line.alias("line")).filter(F.col("line") != "")


def goal_lines(events: DataFrame) -> DataFrame:
    """Readable line per goal event."""
    text = F.when(F.coalesce(F.col("text"), F.lit("")) == "", F.col("type")).otherwise(F.col("text"))
    line = F.concat(F.col("minute").cast("string"), F.lit("' "), F.col("team"), F.lit(" — "), text)
    return events.filter(F.col("type").isin(GOAL_TYPES)).select(
        "fixture_id", "event_order", F.trim(line).alias("line")
    )
