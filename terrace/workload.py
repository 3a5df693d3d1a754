"""Views that give the benchmark tables the shapes of this domain.

A fixture is a two-hour slot of ``events``; kickoff is 20 minutes into it, so
some posts fall before the lead-in. Posts are the click, view and signup events
with a document's whole text, play-by-play lines are the purchase and error
events. Team names and the extra lexicon terms are frequent words of the corpus,
passed as parameters.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions.lexicon import EMOTION_TERMS, PANIC_TERMS, emotion_intensities
from terrace.operators.minutes import posts_to_chat
from terrace.operators.mood import emotion_shares
from terrace.session import fan_out

SLOT_SECONDS = 7200
KICKOFF_SECONDS = 1200

TEAMS = ["That", "With", "From", "Elle", "Pour", "Eine", "Auch", "Dans"]

PHRASES = [
    "goal! clinical finish", "penalty awarded", "big chance missed", "hits the post",
    "shot on target, forces a save", "goes wide of the far post", "blocked at the near post",
    "dangerous free-kick on the left", "wins a corner", "keeps possession in midfield",
]

# Corpus words on top of the built-in lexicon, so that the scores vary on made-up prose.
CORPUS_EMOTIONS = {
    "panic": {"nicht": 0.9, "ther": 0.6, "der ": 0.5},
    "anger": {"and ": 0.4, "une ": 0.8, "die ": 0.4},
    "joy": {"que ": 0.7, "ing ": 0.5, "el ": 0.4},
    "confidence": {"with": 0.5, "auch": 0.6, "los ": 0.5},
    "despair": {"from": 0.9, "und ": 0.7, "re ": 0.3},
    "surprise": {"elle": 0.5, "tion": 0.1, "wh": 0.1},
}
CORPUS_PANIC = {"the ": 0.02, "nicht": 0.2, "que ": -0.05, "with": -0.1, "une ": -0.1, "er ": 0.05}

LEXICON = {name: {**EMOTION_TERMS[name], **CORPUS_EMOTIONS[name]} for name in EMOTION_TERMS}
PANIC = {**PANIC_TERMS, **CORPUS_PANIC}


@lru_cache(maxsize=256)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A benchmark table; the plan node is shared so its footer is read once."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with its fixture and UTC timestamp."""
    df = table(spark, sf_dir, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    slot = F.floor(seconds / F.lit(SLOT_SECONDS * 1_000_000))
    return df.withColumns({
        "created_utc": F.col("ts").cast("timestamp"),
        "slot": slot,
        "fixture_id": F.concat(F.lit("ESPN-"), slot.cast("string")),
    })


def _team(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TEAMS]), (index + 1).cast("int"))


def _fixture_columns(slots: DataFrame) -> DataFrame:
    slot = F.col("slot")
    n = len(TEAMS)
    home = F.pmod(slot, F.lit(n))
    shift = F.pmod(F.floor(slot / n), F.lit(n - 1)) + 1
    return slots.select(
        F.concat(F.lit("ESPN-"), slot.cast("string")).alias("fixture_id"), "slot",
        F.timestamp_seconds(slot * SLOT_SECONDS + KICKOFF_SECONDS).alias("kickoff_utc"),
        _team(home).alias("home_team"), _team(F.pmod(home + shift, F.lit(n))).alias("away_team"),
        F.concat(F.pmod(slot, F.lit(4)).cast("string"), F.lit("-"), F.pmod(F.floor(slot / 3), F.lit(3)).cast("string")).alias("score"),
        F.element_at(F.array(F.lit("pre"), F.lit("in"), F.lit("post")), (F.pmod(slot, F.lit(3)) + 1).cast("int")).alias("state"),
    )


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixture_columns(events(spark, sf_dir).select("slot").distinct())


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts without their text: (fixture_id, created_utc, source, author, ingest_seq, doc_id)."""
    documents = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)))
    return events(spark, sf_dir).filter(F.col("event_type").isin("click", "view", "signup")).select(
        "fixture_id", "created_utc", F.col("event_type").alias("source"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author"),
        F.col("event_id").alias("ingest_seq"), F.pmod("event_id", documents.scalar()).alias("doc_id"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fan_out(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, message): the texts that ``posts`` name."""
    return documents(spark, sf_dir).select("doc_id", F.col("text").alias("message"))


def reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).join(messages(spark, sf_dir), "doc_id")


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts_to_chat(reactions(spark, sf_dir), fixtures(spark, sf_dir))


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, emo_*) intensities; each text is scored once however often it is posted."""
    return emotion_intensities(documents(spark, sf_dir), "text", LEXICON).drop("text", "lang")


def shared_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat rows with emotion shares, texts scored before the join."""
    timed = posts_to_chat(posts(spark, sf_dir), fixtures(spark, sf_dir))
    return timed.join(emotion_shares(scored_documents(spark, sf_dir)), "doc_id")


def commentary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fixture_id, seq, line) play-by-play."""
    e = events(spark, sf_dir).filter(F.col("event_type").isin("purchase", "error"))
    named = _fixture_columns(e.select("slot").distinct()).select("fixture_id", "home_team", "away_team", "kickoff_utc")
    rows = e.join(named, "fixture_id")
    elapsed = F.floor((F.unix_micros("created_utc") - F.unix_micros("kickoff_utc")) / F.lit(60_000_000))
    minute = F.greatest(elapsed, F.lit(0))
    stamp = F.when(minute > 90, F.concat(F.lit("90+"), (minute - 90).cast("string"))).otherwise(minute.cast("string"))
    team = F.when(F.pmod("event_id", F.lit(2)) == 1, F.col("home_team")).otherwise(F.col("away_team"))
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.pmod("event_id", F.lit(len(PHRASES))) + 1).cast("int"))
    return rows.select(
        "fixture_id", F.col("event_id").alias("seq"), F.concat(stamp, F.lit("' "), team, F.lit(": "), phrase).alias("line")
    )
