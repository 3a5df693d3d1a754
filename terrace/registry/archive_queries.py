"""Validated archive, merges, outcome labels and the threshold fit."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terrace import workload as w
from terrace.operators import archive, fitting, threat
from terrace.operators.threat import parse_commentary
from terrace.registry.base import AS_OF, VIEWS, classified, q6, query, rounded, s6, state
from terrace.schemas import EMOTION_COLUMNS
from terrace.session import shared_dir
from terrace.sources import tables

NUMBERS = [
    "crowd_panic_score", *EMOTION_COLUMNS, "emotional_volatility", "rolling_xg", "delta_xg_10min", "arbitrage_index",
    "situation_confidence",
]

# Raw rows with holes and out-of-range values: every event is one, in event order.
_RAW = {
    "crowd_panic_score": "CASE WHEN event_id % 5 <> 0 THEN value / 50.0 - 1.5 END",
    "emo_panic": "CASE WHEN event_id % 3 <> 0 THEN value / 100.0 END",
    "delta_xg_10min": "CASE WHEN event_id % 4 <> 1 THEN value / 60.0 - 0.2 END",
    "arbitrage_index": "value / 80.0",
    "rolling_xg": "CASE WHEN event_id % 6 <> 0 THEN value / 40.0 - 0.5 END",
    "comment_volume": "CASE WHEN event_id % 7 <> 0 THEN event_id % 9 - 2 END",
}


def _carried(col: str, low: str, high: str | None = None) -> str:
    filled = f"coalesce(last_value({col} IGNORE NULLS) OVER so_far, 0)"
    bounded = f"greatest({filled}, {low})"
    return f"least({bounded}, {high})" if high else bounded


VIEWS.update({
    "raw": "SELECT fixture_id, event_id, value, event_type, CASE WHEN event_id % 13 = 0 THEN NULL ELSE minute END AS minute, "
        + ", ".join(f"{sql} AS {name}" for name, sql in _RAW.items())
        + """, CASE WHEN event_id % 2 = 0 THEN event_type END AS dominant_emotion,
        CASE WHEN event_id % 10 < 7 THEN event_id % 3 = 0 END AS flagged FROM (
          SELECT ev.*, (epoch_us(ts) // 60000000) % 120 - 3 + 0.5 AS minute FROM ev)""",
    "rawmin": """SELECT * REPLACE (CAST(greatest(trunc(minute), 0) AS BIGINT) AS minute) FROM raw WHERE minute IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY fixture_id, greatest(trunc(minute), 0) ORDER BY event_id DESC) = 1""",
    "valid": f"""SELECT fixture_id AS match_id, CAST(minute AS INTEGER) AS minute, {_carried('crowd_panic_score', '-1', '1')} AS crowd_panic_score,
        {_carried('emo_panic', '0', '1')} AS emo_panic, {_carried('delta_xg_10min', '0', '1')} AS delta_xg_10min,
        {_carried('arbitrage_index', '0', '1')} AS arbitrage_index, {_carried('rolling_xg', '0')} AS rolling_xg,
        CAST({_carried('comment_volume', '0')} AS INTEGER) AS comment_volume,
        coalesce(last_value(dominant_emotion IGNORE NULLS) OVER so_far, 'neutral') AS dominant_emotion,
        coalesce(flagged, false) AS flagged FROM rawmin
        WINDOW so_far AS (PARTITION BY fixture_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "fwd0": "SELECT *, coalesce(greatest(rolling_xg - lag(rolling_xg) OVER (PARTITION BY fixture_id ORDER BY minute), 0), 0) AS arrival FROM cls",
    "fwd": """SELECT *, coalesce(sum(arrival) OVER (PARTITION BY fixture_id ORDER BY minute ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING), 0)
        AS forward_threat FROM fwd0""",
    "truth": """SELECT *, CASE WHEN abs(crowd_panic_score) > 0.4 AND round(forward_threat, 9) < 0.3 THEN 1.0 ELSE 0.0 END AS overreaction FROM fwd""",
    "grid": """SELECT t / 100.0 AS threshold, avg(-(overreaction * ln(p) + (1 - overreaction) * ln(1 - p))) AS log_loss FROM (
        SELECT t, overreaction, least(greatest(1 / (1 + exp(-8 * (arbitrage_index - t / 100.0))), 1e-7), 1 - 1e-7) AS p
        FROM truth, (SELECT unnest(range(5, 96, 5)) AS t)) GROUP BY t""",
})


def raw_rows(spark, sf):
    """Events as raw state rows with NULLs, repeats and out-of-range values."""
    minute = F.pmod(F.floor(F.unix_micros("created_utc") / 60_000_000), F.lit(120)) - 2.5
    rows = w.events(spark, sf).withColumn("m", minute)
    return rows.select(
        "fixture_id", F.col("event_id").alias("ingest_seq"),
        F.when(F.pmod("event_id", F.lit(13)) != 0, F.col("m")).alias("minute"),
        *[F.expr(sql).alias(name) for name, sql in _RAW.items()],
        F.when(F.pmod("event_id", F.lit(2)) == 0, F.col("event_type")).alias("dominant_emotion"),
        F.when(F.pmod("event_id", F.lit(10)) < 7, F.pmod("event_id", F.lit(3)) == 0).alias("flagged"),
    )


_VALID = ["crowd_panic_score", "emo_panic", "delta_xg_10min", "arbitrage_index", "rolling_xg"]


@query("validated_archive", f"SELECT match_id, minute, {q6(*_VALID)}, comment_volume, dominant_emotion, flagged, 'unknown' AS situation, CAST(0 AS DOUBLE) AS emo_joy FROM valid")
def validated_archive(spark, sf):
    rows = archive.validate_state(raw_rows(spark, sf), F.lit(AS_OF).cast("timestamp"))
    return rounded(rows, *_VALID).select(
        "match_id", "minute", *_VALID, "comment_volume", "dominant_emotion", "flagged", "situation", "emo_joy"
    )


@query("result_rows", """SELECT fixture_id AS match_id, CASE WHEN slot % 5 = 0 THEN 'unknown' ELSE home_team END AS home_team, away_team,
    CASE WHEN slot % 3 = 0 THEN '0-0' ELSE score END AS final_score, CASE WHEN slot % 4 = 0 THEN 'post' ELSE state END AS state FROM fx""")
def result_rows(spark, sf):
    f = w.fixtures(spark, sf)
    holes = f.withColumns({
        "home_team": F.when(F.pmod("slot", F.lit(5)) != 0, F.col("home_team")).otherwise(""),
        "score": F.when(F.pmod("slot", F.lit(3)) != 0, F.col("score")),
        "state": F.when(F.pmod("slot", F.lit(4)) != 0, F.col("state")).otherwise(""),
    })
    return archive.result_rows(holes, F.lit(AS_OF).cast("timestamp")).drop("kickoff_utc", "archived_at")


def _archive_rows(spark, sf):
    ordered = classified(spark, sf).withColumn("ingest_seq", F.col("minute"))
    return archive.validate_state(ordered, F.lit(AS_OF).cast("timestamp"))


@query("old_schema_backfill", "SELECT fixture_id AS match_id, count(*) AS minutes, min('unknown') AS situation, CAST(0 AS DOUBLE) AS situation_confidence FROM cls GROUP BY 1")
def old_schema_backfill(spark, sf):
    old = _archive_rows(spark, sf).drop("situation", "situation_confidence")
    return archive.backfill_columns(old).groupBy("match_id").agg(
        F.count(F.lit(1)).alias("minutes"), F.max("situation").alias("situation"),
        F.max("situation_confidence").alias("situation_confidence"),
    )


@query("old_schema_rows", f"""SELECT fixture_id AS match_id, CAST(minute AS INTEGER) AS minute, {q6('crowd_panic_score', 'rolling_xg')}, dominant_emotion,
    flagged, 'unknown' AS situation, CAST(0 AS DOUBLE) AS situation_confidence FROM cls""")
def old_schema_rows(spark, sf):
    """The same, row by row."""
    old = _archive_rows(spark, sf).drop("situation", "situation_confidence")
    return rounded(archive.backfill_columns(old), "crowd_panic_score", "rolling_xg").select(
        "match_id", "minute", "crowd_panic_score", "rolling_xg", "dominant_emotion", "flagged", "situation", "situation_confidence"
    )


def _table_dir(spark, name: str) -> str:
    """A fresh folder under the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("archive_upsert", f"""SELECT fixture_id AS match_id, CAST(minute AS INTEGER) AS minute,
    CASE WHEN slot % 3 = 0 THEN 1.0 ELSE {s6('crowd_panic_score')} END AS crowd_panic_score, situation FROM cls JOIN fx USING (fixture_id)""")
def archive_upsert(spark, sf):
    """Archive everything, then merge changed rows of every third fixture twice."""
    path = _table_dir(spark, "archive")
    rows = _archive_rows(spark, sf)
    tables.upsert(rows, path, tables.MATCH_ARCHIVE)
    slot = F.split("match_id", "-")[1].cast("bigint")
    changed = rows.filter(F.pmod(slot, F.lit(3)) == 0).withColumn("crowd_panic_score", F.lit(1.0))
    for _ in range(2):
        tables.upsert(changed, path, tables.MATCH_ARCHIVE)
    return rounded(tables.load(spark, path, tables.MATCH_ARCHIVE), "crowd_panic_score").select(
        "match_id", "minute", "crowd_panic_score", "situation"
    )


@query("archive_merge", """SELECT fixture_id AS match_id, CAST(minute AS INTEGER) AS minute, CASE WHEN slot % 3 = 0 THEN minute % 3 = 0 ELSE flagged END AS flagged
    FROM cls JOIN fx USING (fixture_id) WHERE slot % 3 <> 0 OR minute % 2 = 0""")
def archive_merge(spark, sf):
    """Rows of the fixtures at hand replace all their archived ones (a left anti join on the fixture)."""
    rows = _archive_rows(spark, sf).select("match_id", "minute", "flagged")
    slot = F.split("match_id", "-")[1].cast("bigint")
    new = rows.filter((F.pmod(slot, F.lit(3)) == 0) & (F.col("minute") % 2 == 0)).withColumn("flagged", F.col("minute") % 3 == 0)
    return archive.merge_by_key(rows, new, ["match_id"])


@query("reaction_upsert", """SELECT fixture_id AS match_id, count(*) AS n FROM (SELECT DISTINCT fixture_id, event_type FROM ev) GROUP BY 1""")
def reaction_upsert(spark, sf):
    """Two overlapping ticks merged on (fixture, message key); messages are the event types."""
    path = _table_dir(spark, "reactions")
    rows = w.events(spark, sf).select(
        "fixture_id", F.col("event_id").alias("ingest_seq"), F.col("event_type").alias("message"),
        F.lit(0).cast("bigint").alias("minute"), F.lit("s").alias("source"), F.lit("both").alias("team"),
        F.col("user_id").cast("string").alias("author"),
    )
    for tick in (rows.filter(F.col("message") != "view"), rows.filter(F.col("message") != "click")):
        tables.upsert(archive.stored_reactions(tick), path, tables.REACTIONS)
    return tables.load(spark, path, tables.REACTIONS).groupBy("match_id").agg(F.count(F.lit(1)).alias("n"))


@query("sorted_export", "SELECT fixture_id, minute, team, event_type, count(*) AS n FROM mev GROUP BY ALL")
def sorted_export(spark, sf):
    """Events exported sorted and compressed, then read back."""
    path = _table_dir(spark, "export") + "/events"
    tables.export_sorted(parse_commentary(w.commentary(spark, sf)), path, ["fixture_id", "minute"])
    return spark.read.parquet(path).groupBy("fixture_id", "minute", "team", "event_type").agg(F.count(F.lit(1)).alias("n"))


def _corpus(spark, sf):
    return classified(spark, sf).withColumnRenamed("fixture_id", "match_id")


@query("forward_threat", f"SELECT fixture_id AS match_id, minute, {q6('arrival', 'forward_threat')} FROM fwd")
def forward_threat(spark, sf):
    ahead = fitting.with_forward_threat(_corpus(spark, sf))
    return rounded(ahead, "arrival", "forward_threat").select("match_id", "minute", "arrival", "forward_threat")


@query("corpus_truth", "SELECT fixture_id AS match_id, minute, CAST(overreaction AS DOUBLE) AS overreaction FROM truth")
def corpus_truth(spark, sf):
    return fitting.corpus_truth(_corpus(spark, sf)).select("match_id", "minute", "overreaction")


@query("lookahead_truth", """SELECT fixture_id, minute, CAST(CASE WHEN abs(crowd_panic_score) > 0.4 AND NOT EXISTS (
    SELECT 1 FROM mev WHERE mev.fixture_id = st.fixture_id AND event_type IN ('goal', 'penalty')
    AND mev.minute > st.minute AND mev.minute <= st.minute + 15) THEN 1 ELSE 0 END AS DOUBLE) AS overreaction FROM st""")
def lookahead_truth(spark, sf):
    events = threat.parse_commentary(w.commentary(spark, sf))
    return fitting.lookahead_truth(state(spark, sf), events).select("fixture_id", "minute", "overreaction")


@query("threshold_grid", f"SELECT CAST(threshold AS DOUBLE) AS threshold, {q6('log_loss')} FROM grid")
def threshold_grid(spark, sf):
    return rounded(fitting.threshold_grid(fitting.corpus_truth(_corpus(spark, sf))), "log_loss")


@query("best_threshold", f"SELECT CAST(threshold AS DOUBLE) AS threshold, {q6('log_loss')} FROM grid ORDER BY grid.log_loss, threshold LIMIT 1")
def best_threshold(spark, sf):
    grid = fitting.threshold_grid(fitting.corpus_truth(_corpus(spark, sf)))
    return rounded(fitting.best_threshold(grid), "log_loss")


@query("fit_threshold", f"""SELECT CAST(threshold AS DOUBLE) AS threshold, {q6('log_loss')}, (SELECT count(*) FROM truth) AS evaluated_minutes,
    (SELECT count(DISTINCT fixture_id) FROM truth) AS matches, 'fitted' AS status FROM grid ORDER BY grid.log_loss, threshold LIMIT 1""")
def fit_threshold(spark, sf):
    return rounded(fitting.fit_threshold(_corpus(spark, sf)), "log_loss")


@query("flag_log_loss", f"""SELECT {s6('avg(-(overreaction * ln(p) + (1 - overreaction) * ln(1 - p)))')} AS log_loss FROM (
    SELECT overreaction, least(greatest(arbitrage_index, 1e-7), 1 - 1e-7) AS p FROM truth)""")
def flag_log_loss(spark, sf):
    return rounded(fitting.log_loss(fitting.corpus_truth(_corpus(spark, sf)), "overreaction", "arbitrage_index"), "log_loss")
