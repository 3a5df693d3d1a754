"""Readings of the latest minute: takeaways, headlines, triggers, underdog evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.numbers import half_even
from terrace.functions.text import strip


def _fixed(col: Column, pattern: str = "%.2f") -> Column:
    return F.format_string(pattern, col)


def _whole(col: Column) -> Column:
    return F.format_string("%.0f", F.rint(col))


def pitch_notes(stats: DataFrame) -> DataFrame:
    """One sentence per fixture with each team's possession and shots on target."""
    def value(stat: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("stat") == stat, F.col("value"))), F.lit("?"))

    teams = stats.groupBy("fixture_id", "team_order", "team").agg(
        value("possessionPct").alias("poss"), value("shotsOnTarget").alias("sot")
    )
    fragment = F.concat("team", F.lit(": "), "poss", F.lit("% possession, "), "sot", F.lit(" on target"))
    listed = teams.groupBy("fixture_id").agg(
        F.sort_array(F.collect_list(F.struct("team_order", fragment.alias("text")))).alias("_f")
    )
    text = F.array_join(F.transform("_f", lambda f: f["text"]), "; ")
    return listed.select("fixture_id", F.concat(F.lit(" Pitch data - "), text, F.lit(".")).alias("note"))


def takeaways(latest: DataFrame, threshold: float, notes: DataFrame, keepers: DataFrame) -> DataFrame:
    """Rule-based readings of each fixture's latest minute, one row per reading.

    ``keepers`` is one row per fixture: keeper, saves, shots_faced.
    """
    joined = latest.join(notes, "fixture_id", "left").join(keepers, "fixture_id", "left")
    panic, stability = F.col("crowd_panic_score"), F.col("delta_xg_10min")
    note = F.coalesce("note", F.lit(""))
    dominant = F.col("dominant_emotion")
    saves = F.coalesce("saves", F.lit(0.0))
    faced = F.coalesce("shots_faced", F.lit(0.0))
    steady = _fixed(stability)

    def reading(tone: str, headline: str, *detail: Column | str) -> Column:
        parts = [d if isinstance(d, Column) else F.lit(d) for d in detail]
        return F.struct(
            F.lit(tone).alias("tone"), F.lit(headline).alias("headline"), F.concat(*parts).alias("detail")
        )

    rules = F.array_compact(F.array(
        F.when((F.col("arbitrage_index") >= threshold) & (panic > 0), reading(
            "warning", "Market overreaction signal",
            "Crowd mood is dominated by ", dominant, " while the underlying threat level is stable "
            "(xG stability ", steady, "). Historically the spot where sentiment-driven prices "
            "decouple from the pitch.", note)),
        F.when((panic <= -0.4) & (stability < 0.3), reading(
            "warning", "Complacency risk",
            "The crowd is euphoric/confident but the match data shows little attacking control "
            "(xG stability ", steady, "). Sentiment may be lagging a genuine momentum shift.", note)),
        F.when(F.col("emo_anger") >= 0.35, reading(
            "info", "Anger-driven sentiment",
            "A large share of reactions are about officiating or frustration, not match state. "
            "Treat the panic score as noisy until this clears.")),
        F.when(F.col("emotional_volatility") >= 0.5, reading(
            "info", "Unstable crowd mood",
            "Emotional volatility is high (", _fixed(half_even(F.col("emotional_volatility"), 2)),
            "); the crowd is reacting to every event. Wait for the mood to settle before "
            "trusting the signal.")),
        F.when(F.col("keeper").isNotNull() & (panic > 0.3) & (saves >= 3), reading(
            "info", "Keeper holding the line",
            "Fans are anxious, but ", F.col("keeper"), " has made ", _whole(saves), " saves",
            F.when(faced > 0, F.concat(F.lit(" from "), _whole(faced), F.lit(" shots faced"))).otherwise(""),
            " - the pressure is real but it is being handled.")),
    ))
    aligned = F.array(reading(
        "positive", "Sentiment aligned with match state",
        "Dominant emotion (", dominant, ") is consistent with the pitch data (panic ",
        _fixed(panic, "%+.2f"), ", xG stability ", steady, "). No divergence to exploit right now.", note))
    return joined.select(
        "fixture_id", F.posexplode(F.when(F.size(rules) > 0, rules).otherwise(aligned)).alias("position", "r")
    ).select("fixture_id", "position", "r.*")


def headlines(latest: DataFrame, threshold: float, mood: DataFrame | None = None) -> DataFrame:
    """One sentence per fixture; ``mood`` adds the sides that have any reactions."""
    panic, stability = F.col("crowd_panic_score"), F.col("delta_xg_10min")
    feel = F.when(panic > 0.25, "anxious").when(panic < -0.25, "calm and confident").otherwise("split")
    match = (
        F.when(stability >= 0.45, "the match is producing real chances")
        .when(stability <= 0.2, "the match itself is fairly quiet")
        .otherwise("the match is evenly balanced")
    )
    tail = (
        F.when((F.col("arbitrage_index") >= threshold) & (panic > 0),
               "fans are spiking faster than the pitch justifies — a possible overreaction.")
        .when((panic <= -0.4) & (stability < 0.3),
              "fans look relaxed even though the game is flat — watch for a momentum swing.")
        .otherwise("fan mood and the match are roughly in step.")
    )
    who = F.lit("")
    if mood is not None:
        def said(side: str) -> Column:
            return F.max(F.when((F.col("side") == side) & (F.col("volume") > 0),
                                F.concat("team", F.lit(" fans: "), "dominant")))

        sides = mood.groupBy("fixture_id").agg(said("home").alias("_home"), said("away").alias("_away"))
        latest = latest.join(sides, "fixture_id", "left")
        listed = F.concat_ws(" | ", "_home", "_away")
        who = F.when(listed == "", "").otherwise(F.concat(F.lit(" "), listed, F.lit(".")))
    return latest.select("fixture_id", F.concat(
        F.lit("Right now: fans are "), feel, F.lit(" while "), match, F.lit(" — "), tail, who
    ).alias("headline"))


def overreaction_trigger(latest: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Fixtures whose latest minute is flagged, or with a mood conflict now."""
    now = conflicts.select("fixture_id").distinct().withColumn("_conflict", F.lit(True))
    return latest.join(now, "fixture_id", "left").select(
        "fixture_id",
        (F.coalesce("flagged", F.lit(False)) | F.coalesce("_conflict", F.lit(False))).alias("overreacting"),
    )


def underdog_evidence(
    fixtures: DataFrame, latest: DataFrame, stats: DataFrame, keepers: DataFrame, market: DataFrame
) -> DataFrame:
    """The side least likely to win and the numbers that speak for it.

    Trailing side first; level games need a market (fixture_id, home_prob,
    away_prob). Fixtures without a clear side, or without evidence, give no row.
    """
    parts = F.split(F.replace(F.coalesce("score", F.lit("")), F.lit("–"), F.lit("-")), "-", -1)
    home_goals = strip(F.get(parts, F.lit(0))).try_cast("int")
    away_goals = strip(F.get(parts, F.lit(1))).try_cast("int")
    priced = (F.col("home_prob") > 0) & (F.col("away_prob") > 0)
    home_is = (
        F.when(home_goals < away_goals, True).when(away_goals < home_goals, False)
        .when(priced, F.col("home_prob") < F.col("away_prob"))
    )
    sided = (
        fixtures.join(market, "fixture_id", "left")
        .filter(home_goals.isNotNull() & away_goals.isNotNull())
        .withColumn("_home_is", home_is)
        .filter(F.col("_home_is").isNotNull())
        .select(
            "fixture_id", "score",
            F.when(F.col("_home_is"), F.col("home_team")).otherwise(F.col("away_team")).alias("underdog"),
            F.when(F.col("_home_is"), F.col("away_team")).otherwise(F.col("home_team")).alias("opponent"),
        )
    )
    shots = stats.filter(F.col("stat") == "shotsOnTarget").select(
        "fixture_id", F.col("team").alias("underdog"), F.col("value").alias("_shots")
    )
    against = keepers.select("fixture_id", F.col("team").alias("opponent"), F.col("saves").alias("_saves"))
    now = latest.select("fixture_id", "minute", F.col("delta_xg_10min").alias("_threat"))
    joined = (
        sided.join(shots, ["fixture_id", "underdog"], "left")
        .join(against, ["fixture_id", "opponent"], "left")
        .join(now, "fixture_id", "left")
    )
    evidence = F.array_compact(F.array(
        F.when(~F.coalesce("_shots", F.lit("")).isin("", "0", "0.0"), F.concat("_shots", F.lit(" shots on target"))),
        F.when(F.col("_threat") >= 0.3, F.concat(F.lit("live attacking threat "), _fixed(F.col("_threat")))),
        F.when(F.col("_saves") >= 3, F.concat(
            "opponent", F.lit("'s keeper has needed "), _whole(F.col("_saves")),
            F.lit(" saves to keep this scoreline"))),
    ))
    return joined.select(
        "fixture_id", "underdog", "opponent", "score", F.coalesce("minute", F.lit(0)).alias("minute"),
        F.explode(F.when(F.size(evidence) > 0, F.array(F.array_join(evidence, "; ")))).alias("evidence"),
    )
