"""Team priors from a schedule, and a fixture's view of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.numbers import exact_round, score_goals
from terrace.functions.text import strip


def team_priors(schedule: DataFrame, team_stats: DataFrame | None = None, updated_at: Column | None = None) -> DataFrame:
    """Played, goals for and against per match; xG and possession when statistics exist.

    ``team_stats`` is (team, played, xg, possession) of the season; its xG is
    divided by ``played`` where that is positive. Without any played match the
    statistics alone make the table.
    """
    goals = score_goals(F.col("score"))
    rows = (
        schedule.withColumn("_g", goals)
        .filter(F.col("_g").isNotNull())
        .select(F.explode(F.array(
            F.struct(strip(F.col("home_team")).alias("team"), F.col("_g.home").alias("scored"), F.col("_g.away").alias("conceded")),
            F.struct(strip(F.col("away_team")).alias("team"), F.col("_g.away").alias("scored"), F.col("_g.home").alias("conceded")),
        )).alias("r"))
        .select("r.*")
    )
    played = rows.groupBy("team").agg(
        F.count(F.lit(1)).alias("matches_played"),
        F.avg("scored").alias("goals_for_per_match"),
        F.avg("conceded").alias("goals_against_per_match"),
    )
    stamp = F.current_timestamp() if updated_at is None else updated_at
    if team_stats is None:
        none = F.lit(None).cast("double")
        return played.select("*", none.alias("xg_for_per_match"), none.alias("possession_pct"), stamp.alias("updated_at"))
    matches = F.col("played").try_cast("double")
    xg = F.col("xg").try_cast("double")
    extra = team_stats.select(
        "team",
        F.when(matches > 0, xg / matches).otherwise(xg).alias("xg_for_per_match"),
        F.col("possession").try_cast("double").alias("possession_pct"),
    )
    any_match = rows.limit(1).agg(F.count(F.lit(1))).scalar() > 0
    table = played.join(extra, "team", "full").filter(F.col("matches_played").isNotNull() | ~any_match)
    return table.withColumn("updated_at", stamp)


def fixture_prior(fixtures: DataFrame, priors: DataFrame) -> DataFrame:
    """Both sides' priors and the goal-difference edge; no row when neither side is known."""
    first = priors.groupBy(F.lower(F.col("team")).alias("_team")).agg(
        # of spellings that differ in case alone, the first in order
        F.min_by(F.struct("goals_for_per_match", "goals_against_per_match", "matches_played"), F.col("team")).alias("_p")
    )

    def side(name: str) -> DataFrame:
        return first.select(
            F.col("_team").alias(f"_{name}"), F.col("_p.matches_played").alias(f"{name}_played"),
            (F.col("_p.goals_for_per_match") - F.col("_p.goals_against_per_match")).alias(f"{name}_goal_diff"),
        )

    keyed = fixtures.select(
        "fixture_id", strip(F.lower("home_team")).alias("_home"), strip(F.lower("away_team")).alias("_away")
    )
    joined = keyed.join(side("home"), "_home", "left").join(side("away"), "_away", "left")
    return joined.filter(F.col("home_played").isNotNull() | F.col("away_played").isNotNull()).select(
        "fixture_id", "home_played", "home_goal_diff", "away_played", "away_goal_diff",
        exact_round(F.col("home_goal_diff") - F.col("away_goal_diff"), 2).alias("edge"),
    )
