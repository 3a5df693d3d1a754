"""Streaming jobs over landed files: de-dup, minute windows, mood, buffers, late rows, heartbeats, alerts.

Row windows (forward fill, lag, rolling rows) do not exist on streams; the keyed
state they need lives in ``state``. Sinks are keyed tables whose writes carry the
number of the tick, or folders of one tick, so a replayed tick changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrace.functions.lexicon import EMOTION_TERMS, Lexicon, emotion_intensities
from terrace.functions.text import normalised
from terrace.operators import cleaning, health, mood
from terrace.operators.minutes import posts_to_chat
from terrace.sources import tables
from terrace.streaming import state
from terrace.streaming.state import LATENESS

TICK = "60 seconds"

BUFFER = (
    "fixture_id STRING, created_utc TIMESTAMP, message STRING, source STRING, author STRING, ingest_seq BIGINT"
)
MOOD_SERIES = tables.Keyed(state.SERIES, ("fixture_id", "minute"))
BUFFERED = tables.Keyed(BUFFER, ("fixture_id", "message"), ("fixture_id",))
MINUTE_COUNTS = tables.Keyed("fixture_id STRING, minute_start TIMESTAMP, n BIGINT", ("fixture_id", "minute_start"))
THREAT_WINDOWS = tables.Keyed("fixture_id STRING, window_start TIMESTAMP, xg DOUBLE", ("fixture_id", "window_start"))
TICK_COUNTS = tables.Keyed("fixture_id STRING, kind STRING, source STRING, n BIGINT", ("fixture_id", "kind", "source"))


def landed_stream(
    spark: SparkSession, path: str, schema: str, fmt: str = "parquet", glob: str | None = None, files_per_tick: int | None = None
) -> DataFrame:
    """Landed files as a stream."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_tick:
        reader = reader.option("maxFilesPerTrigger", files_per_tick)
    return reader.load(path)


def without_repeats(posts: DataFrame, keys: tuple[str, ...] = ("fixture_id", "_key")) -> DataFrame:
    """First of equal messages per fixture while the watermark remembers it.

    State is bounded by the watermark; the exact form over a bounded buffer is
    ``keep_buffer``.
    """
    keyed = posts.withColumn("_key", F.sha2(normalised(F.col("message")), 256)) if "_key" in keys else posts
    kept = keyed.withWatermark("created_utc", LATENESS).dropDuplicatesWithinWatermark(list(keys))
    return kept.drop("_key")


def minute_counts(posts: DataFrame) -> DataFrame:
    """Posts per fixture and clock minute; both aggregate partially before the shuffle."""
    return (
        posts.withWatermark("created_utc", LATENESS)
        .groupBy("fixture_id", F.window("created_utc", "1 minute").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("fixture_id", F.col("w.start").alias("minute_start"), "n")
    )


def threat_windows(events: DataFrame) -> DataFrame:
    """Summed xG of the ten minutes behind every minute."""
    return (
        events.withWatermark("created_utc", LATENESS)
        .groupBy("fixture_id", F.window("created_utc", "10 minutes", "1 minute").alias("w"))
        .agg(F.sum("xg_value").alias("xg"))
        .select("fixture_id", F.col("w.start").alias("window_start"), "xg")
    )


def mood_windows(scored: DataFrame, column: str = "panic", minutes: int = mood.MOOD_WINDOW) -> DataFrame:
    """Mean of the minute means of the ``minutes`` behind every minute: two chained window aggregates, append mode."""
    means = (
        scored.withWatermark("created_utc", LATENESS)
        .groupBy("fixture_id", F.window("created_utc", "1 minute").alias("m")).agg(F.avg(column).alias("_mean"))
        .select("fixture_id", F.window_time("m").alias("_at"), "_mean")
    )
    wide = F.window("_at", f"{minutes} minutes", "1 minute").alias("w")
    return means.groupBy("fixture_id", wide).agg(F.avg("_mean").alias("mood")).select("fixture_id", "w", "mood")


def mood_with_threat(scored: DataFrame, events: DataFrame) -> DataFrame:
    """Mood and threat of the windows that end together: a stream-stream join on fixture and window time."""
    threat = (
        events.withWatermark("created_utc", LATENESS)
        .groupBy("fixture_id", F.window("created_utc", "10 minutes", "1 minute").alias("w")).agg(F.sum("xg_value").alias("xg"))
        .select("fixture_id", F.window_time("w").alias("window_time"), "xg")
    )
    windows = mood_windows(scored).select("fixture_id", F.window_time("w").alias("window_time"), "mood")
    return windows.join(threat, ["fixture_id", "window_time"])


def split_frozen(batch: DataFrame, fixtures: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Rows of fixtures still being captured, and the late rows of frozen ones.

    ``fixtures`` is (fixture_id, state, kickoff_utc, post_first_seen).
    """
    phased = with_phase(batch, fixtures, as_of)
    frozen = F.coalesce(F.col("_phase") == "frozen", F.lit(False))
    return phased.filter(~frozen).drop("_phase"), phased.filter(frozen).drop("_phase")


def with_phase(batch: DataFrame, fixtures: DataFrame, as_of: Column) -> DataFrame:
    phase = health.capture_phase(F.col("state"), F.col("kickoff_utc"), as_of, F.col("post_first_seen"))
    return batch.join(fixtures.select("fixture_id", phase.alias("_phase")), "fixture_id", "left")


def late_and_live(base: str, fixtures: Callable[[SparkSession], DataFrame], as_of: Column) -> Callable[[DataFrame, int], None]:
    """Batch function with two sinks: rows of frozen fixtures go to ``late``, all others to ``live``.

    The fixture table is read at each tick, so a fixture that freezes is routed
    anew from then on. One write of a tick makes both folders, and a replay
    overwrites them.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        frozen = F.coalesce(F.col("_phase") == "frozen", F.lit(False))
        routed = with_phase(batch, fixtures(batch.sparkSession), as_of)
        route = F.when(frozen, "late").otherwise("live")
        routed.withColumn("route", route).drop("_phase").write.mode("overwrite").partitionBy("route").parquet(f"{base}/routed/tick={batch_id}")

    return run


def routed(spark: SparkSession, base: str, schema: str, route: str | None = None) -> DataFrame:
    """What ``late_and_live`` wrote, all rows (with ``route``) or one route."""
    rows = tables.scan(spark, f"{base}/routed", f"{schema}, tick BIGINT, route STRING").drop("tick")
    return rows if route is None else rows.filter(F.col("route") == route).drop("route")


def shared_chat(posts: DataFrame, fixtures: DataFrame, lexicon: Lexicon = EMOTION_TERMS, text: str = "message") -> DataFrame:
    """Stream of posts to chat rows with emotion shares and the kickoff of their fixture."""
    chat = posts_to_chat(posts, fixtures).join(fixtures.select("fixture_id", "kickoff_utc"), "fixture_id")
    return mood.emotion_shares(emotion_intensities(chat, text, lexicon))


def keep_buffer(path: str, limit: int = cleaning.NEWEST) -> Callable[[DataFrame, int], None]:
    """Batch function: the newest rows per fixture, copies removed across ticks."""
    def run(batch: DataFrame, batch_id: int) -> None:
        prior = tables.load(batch.sparkSession, path, BUFFERED)
        touched = batch.select("fixture_id").distinct()
        merged = cleaning.merge_buffer(prior.join(touched, "fixture_id", "left_semi"), batch, limit)
        tables.upsert(merged, path, BUFFERED, at=batch_id)

    return run


def upsert_sink(path: str, table: tables.Keyed) -> Callable[[DataFrame, int], None]:
    """Batch function: keyed merge of the rows a tick changed."""
    def run(batch: DataFrame, batch_id: int) -> None:
        tables.upsert(batch, path, table, at=batch_id)

    return run


def tick_counts(landed: DataFrame) -> DataFrame:
    """Rows so far by fixture, kind (``post`` or ``line``) and source, one scan a tick; the tick itself is observed as ``tick``."""
    seen = landed.observe("tick", F.count(F.lit(1)).alias("rows"), F.max("created_utc").alias("newest"))
    return seen.groupBy("fixture_id", "kind", "source").agg(F.count(F.lit(1)).alias("n"))


def heartbeats(spark: SparkSession, path: str, as_of: Column) -> DataFrame:
    """Heartbeat rows from the counts that ``tick_counts`` keeps in ``path``."""
    counts = tables.load(spark, path, TICK_COUNTS)
    posts = counts.filter("kind = 'post'").select("fixture_id", "source", "n")
    lines = counts.filter("kind = 'line'").groupBy("fixture_id").agg(F.sum("n").alias("n_commentary"))
    return health.status_rows(posts, lines, counts.select("fixture_id").distinct(), as_of)


def run_to_end(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> list[dict]:
    """Drain what has landed, tick by tick, then stop; gives what was observed at each tick with rows."""
    query = (
        stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    observed = [(p.batchId, p.observedMetrics) for p in query.recentProgress if p.numInputRows]
    return [{"tick": tick, **row.asDict()} for tick, metrics in observed for row in metrics.values()]


def run_live(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Keep running, one tick a minute."""
    return (
        stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(processingTime=TICK).start()
    )
