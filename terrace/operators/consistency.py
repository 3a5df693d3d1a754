"""Does a side's mood fit the game: context, clarity, verdicts and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.numbers import exact_round, score_goals
from terrace.schemas import EMOTION_COLUMNS

POSITIVE = ["joy", "confidence"]
NEGATIVE = ["panic", "despair", "anger"]

# Weights of the clarity blend and the volume that counts as full.
CLARITY_WEIGHTS = {"margin": 0.5, "coverage": 0.3, "volume": 0.2}
FULL_VOLUME = 30
FEW_SAVES = 2


def game_context(fixtures: DataFrame, threat: DataFrame, keepers: DataFrame) -> DataFrame:
    """Two rows per fixture: side, team, status, margin, threat and keeper saves.

    ``threat`` is (fixture_id, delta_xg_10min) of the latest minute, ``keepers``
    is (fixture_id, team, saves, ...). An unreadable score counts as 0-0.
    """
    goals = score_goals(F.col("score"))
    scored = fixtures.withColumns({
        "_h": F.coalesce(goals["home"], F.lit(0)), "_a": F.coalesce(goals["away"], F.lit(0)),
    })
    sides = F.array(
        F.struct(F.lit("home").alias("side"), F.col("home_team").alias("team"),
                 F.col("_h").alias("own"), F.col("_a").alias("other")),
        F.struct(F.lit("away").alias("side"), F.col("away_team").alias("team"),
                 F.col("_a").alias("own"), F.col("_h").alias("other")),
    )
    rows = scored.select("fixture_id", F.explode(sides).alias("s")).select("fixture_id", "s.*")
    status = (
        F.when(F.col("own") > F.col("other"), "leading")
        .when(F.col("own") < F.col("other"), "trailing")
        .otherwise("level")
    )
    return (
        rows.join(threat.select("fixture_id", F.col("delta_xg_10min").alias("threat")), "fixture_id", "left")
        .join(keepers.select("fixture_id", "team", F.col("saves").alias("keeper_saves")), ["fixture_id", "team"], "left")
        .select(
            "fixture_id", "side", "team", status.alias("status"),
            F.abs(F.col("own") - F.col("other")).alias("margin"),
            F.coalesce("threat", F.lit(0.0)).alias("threat"),
            F.coalesce("keeper_saves", F.lit(0.0)).alias("keeper_saves"),
        )
    )


def clarity() -> Column:
    """How decisive a side's mood reading is, in 0..1."""
    ranked = F.sort_array(F.array(*EMOTION_COLUMNS), asc=False)
    margin = F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1))
    volume = F.least(F.lit(1.0), F.col("volume") / F.lit(float(FULL_VOLUME)))
    w = CLARITY_WEIGHTS
    blend = w["margin"] * margin + w["coverage"] * F.col("coverage") + w["volume"] * volume
    return exact_round(F.least(F.lit(1.0), blend), 4)


def with_clarity(mood: DataFrame) -> DataFrame:
    return mood.withColumn("clarity", clarity())


def mood_verdicts(mood: DataFrame, context: DataFrame) -> DataFrame:
    """Verdict and explanation per fixture and side."""
    ctx = context.select(
        "fixture_id", "side", F.col("team").alias("_team"), "status", "margin", "keeper_saves"
    )
    joined = with_clarity(mood).join(ctx, ["fixture_id", "side"], "left").withColumns({
        "team": F.coalesce("team", "_team", "side"),
        "status": F.coalesce("status", F.lit("level")),
        "margin": F.coalesce("margin", F.lit(0)),
        "keeper_saves": F.coalesce("keeper_saves", F.lit(0.0)),
    })
    upbeat_behind = (F.col("status") == "trailing") & F.col("dominant").isin(POSITIVE)
    tense_ahead = (F.col("status") == "leading") & F.col("dominant").isin(NEGATIVE)
    saves = F.format_string("%.0f", F.rint("keeper_saves"))
    quiet_goal = F.col("keeper_saves") <= FEW_SAVES
    explanation = (
        F.when(upbeat_behind, F.concat(
            "team", F.lit(" trail by "), F.col("margin").cast("string"), F.lit(" yet fan mood reads "), "dominant",
            F.lit(" - conflicting with the game situation. Either a genuine anomaly (e.g. a "
                  "consolation goal or pride in the performance) or a misread window; treat as a "
                  "possible overreaction moment.")))
        .when(tense_ahead & quiet_goal, F.concat(
            "team", F.lit(" lead by "), F.col("margin").cast("string"),
            F.lit(" and their goal is not under siege (keeper saves: "), saves,
            F.lit("), yet fan mood reads "), "dominant",
            F.lit(" - nervousness ahead of the game situation; classic overreaction territory.")))
        .when(tense_ahead, F.concat(
            "team", F.lit(" lead but the keeper is busy ("), saves, F.lit(" saves), so a "), "dominant",
            F.lit(" crowd is understandable - the lead is under pressure.")))
        .otherwise(F.concat("team", F.lit(" fans read as "), "dominant",
                            F.lit(", which fits a side that is "), "status", F.lit(".")))
    )
    verdict = F.when(upbeat_behind | (tense_ahead & quiet_goal), "conflict").otherwise("consistent")
    return joined.select(
        "fixture_id", "side", "team", verdict.alias("verdict"), explanation.alias("explanation"),
        "clarity", "dominant", "status",
    )


def conflict_moments(verdicts: DataFrame) -> DataFrame:
    reason = F.when(F.col("status") == "trailing", "positive-while-losing").otherwise("panic-while-ahead")
    return verdicts.filter(F.col("verdict") == "conflict").select(
        "fixture_id", "side", reason.alias("reason"), "team", F.col("explanation").alias("detail")
    )
