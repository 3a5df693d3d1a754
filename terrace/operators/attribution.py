"""Which side a reaction talks about, and each side's mood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.numbers import half_even
from terrace.functions.text import strip
from terrace.operators.mood import dominant_emotion, total_intensity
from terrace.schemas import EMOTION_COLUMNS

# Extra tokens for names that contain the key.
ALIASES: dict[str, list[str]] = {
    "korea republic": ["south korea", "korea", "taeguk"],
    "south korea": ["korea republic", "korea"],
    "united states": ["usa", "usmnt", "usneverything"],
    "ivory coast": ["cote d'ivoire", "cote divoire"],
    "netherlands": ["holland", "oranje"],
    "england": ["three lions", "engl"],
    "argentina": ["albiceleste", "argentinos"],
    "brazil": ["brasil", "selecao", "seleção"],
    "germany": ["deutschland", "die mannschaft"],
    "spain": ["espana", "españa", "la roja"],
    "mexico": ["el tri", "mexicanos"],
    "portugal": ["seleccao", "seleção das quinas"],
    "france": ["les bleus", "francia"],
    "croatia": ["hrvatska", "vatreni"],
}
STOP_WORDS = ["team", "republic", "and"]


def team_tokens(name: Column) -> Column:
    """Whole name, its words of four letters or more, and its aliases; lower-case, distinct."""
    clean = strip(F.lower(F.coalesce(name, F.lit(""))))
    words = F.filter(
        F.regexp_extract_all(clean, F.lit("([a-z']+)"), 1),
        lambda w: (F.length(w) >= 4) & ~w.isin(STOP_WORDS),
    )
    extra = [
        F.when(F.contains(clean, F.lit(key)), F.array(*[F.lit(t) for t in tokens])).otherwise(
            F.array().cast("array<string>")
        )
        for key, tokens in ALIASES.items()
    ]
    tokens = F.array_distinct(F.concat(F.array(clean), words, *extra))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(tokens)


def mentions(message: Column, tokens: Column) -> Column:
    """Whether any token occurs in an already lower-cased message."""
    return F.exists(tokens, lambda t: F.contains(message, t))


def side_label(home: Column, away: Column) -> Column:
    return (
        F.when(home & away, "both").when(home, "home").when(away, "away").otherwise("neither")
    )


def with_tokens(fixtures: DataFrame) -> DataFrame:
    return fixtures.select(
        "fixture_id",
        team_tokens(F.col("home_team")).alias("_home"),
        team_tokens(F.col("away_team")).alias("_away"),
    )


def tag_teams(reactions: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Add ``team``: home, away, both or neither, by substring."""
    joined = reactions.join(with_tokens(fixtures), "fixture_id", "left")
    low = joined.withColumn("_low", F.lower(F.coalesce(F.col("message"), F.lit(""))))
    none = F.lit(False)
    return low.withColumn(
        "team",
        side_label(
            F.coalesce(mentions(F.col("_low"), F.col("_home")), none),
            F.coalesce(mentions(F.col("_low"), F.col("_away")), none),
        ),
    ).drop("_home", "_away", "_low")


def reactions_of_side(tagged: DataFrame, side: str) -> DataFrame:
    return tagged.filter(F.col("team").isin(side, "both"))


def attribution_coverage(tagged: DataFrame, keys: tuple[str, ...] = ("fixture_id",)) -> DataFrame:
    known = F.when(F.col("team").isin("home", "away", "both"), 1.0).otherwise(0.0)
    return tagged.groupBy(*keys).agg(half_even(F.avg(known), 4).alias("attributed"))


def tag_counts(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("fixture_id", "team").agg(F.count(F.lit(1)).alias("n"))


def side_mood(shared: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Mean shares, dominant emotion, volume and coverage per fixture and side.

    ``shared`` holds tagged messages with their shares; ``both`` counts twice.
    Every fixture has a home and an away row, silent sides at neutral and 0.
    """
    sides = F.when(F.col("team") == "both", F.array(F.lit("home"), F.lit("away"))).when(
        F.col("team").isin("home", "away"), F.array("team")
    ).otherwise(F.array().cast("array<string>"))
    hit = F.when(total_intensity() > 0, 1.0).otherwise(0.0)
    means = (
        shared.select("fixture_id", F.explode(sides).alias("side"), *EMOTION_COLUMNS)
        .groupBy("fixture_id", "side")
        .agg(
            *[F.avg(c).alias(c) for c in EMOTION_COLUMNS],
            F.count(F.lit(1)).alias("volume"),
            half_even(F.avg(hit), 4).alias("coverage"),
        )
    )
    both_sides = fixtures.select(
        "fixture_id",
        F.explode(F.array(
            F.struct(F.lit("home").alias("side"), F.col("home_team").alias("team")),
            F.struct(F.lit("away").alias("side"), F.col("away_team").alias("team")),
        )).alias("_s"),
    ).select("fixture_id", "_s.side", F.when(F.coalesce(F.col("_s.team"), F.lit("")) == "", F.col("_s.side")).otherwise(F.col("_s.team")).alias("team"))
    joined = both_sides.join(means, ["fixture_id", "side"], "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0.0)) for c in (*EMOTION_COLUMNS, "coverage")}
    )
    return joined.withColumn("dominant", dominant_emotion()).select(
        "fixture_id", "side", "team", "dominant",
        *[half_even(F.col(c), 4).alias(c) for c in EMOTION_COLUMNS],
        F.coalesce("volume", F.lit(0).cast("bigint")).alias("volume"), "coverage",
    )


def shares_map(mood: DataFrame) -> DataFrame:
    """The nested form: shares as one map column."""
    pairs = [x for c in EMOTION_COLUMNS for x in (F.lit(c), F.col(c))]
    return mood.withColumn("shares", F.create_map(*pairs)).drop(*EMOTION_COLUMNS)
