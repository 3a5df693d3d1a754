"""Posts to minutes, lexicon scores, mood series, play-by-play, divergence and situations."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrace import workload as w
from terrace.functions import lexicon
from terrace.operators import containment, mood, selector, situation, threat
from terrace.operators.minutes import latest, posts_to_chat
from terrace.registry.base import (
    BALANCE, EMO_SUM, PER_FIXTURE, classified, dominant_sql, ffill, mood_series, q6, query, r6,
    rounded, s6, state, term_sum,
)
from terrace.schemas import EMOTION_COLUMNS, EMOTIONS

SERIES_COLUMNS = [*EMOTION_COLUMNS, "crowd_panic_score", "emotional_volatility"]


@query("minute_map", "SELECT ingest_seq, fixture_id, minute FROM timed")
def minute_map(spark, sf):
    return posts_to_chat(w.posts(spark, sf), w.fixtures(spark, sf)).select("ingest_seq", "fixture_id", "minute")


@query("lexicon_panic", f"""SELECT doc_id, {s6('tanh(' + term_sum('low', w.PANIC) + ')')} AS panic
    FROM (SELECT doc_id, lower(text) AS low FROM documents)""")
def lexicon_panic(spark, sf):
    return lexicon.panic_score(w.documents(spark, sf), "text", w.PANIC).select("doc_id", r6("panic"))


@query("emotion_intensities", f"SELECT doc_id, {q6(*EMOTION_COLUMNS)} FROM emo")
def emotion_intensities(spark, sf):
    return rounded(w.scored_documents(spark, sf), *EMOTION_COLUMNS)


@query("emotion_intensities_builtin", f"SELECT doc_id, {q6(*EMOTION_COLUMNS)} FROM emo")
def emotion_intensities_builtin(spark, sf):
    docs = w.documents(spark, sf)
    return rounded(lexicon.builtin_intensities(docs, "text", w.LEXICON).drop("text", "lang"), *EMOTION_COLUMNS)


@query("emotion_intensities_table", f"SELECT doc_id, {q6(*EMOTION_COLUMNS)} FROM emo")
def emotion_intensities_table(spark, sf):
    """The form for lexicons held as a table: an anchored containment join."""
    rows = [(c, t, float(x)) for c, terms in w.LEXICON.items() for t, x in terms.items()]
    table = spark.createDataFrame(rows, "category STRING, term STRING, weight DOUBLE")
    scores = containment.lexicon_table_scores(w.documents(spark, sf), "doc_id", "text", table, list(EMOTIONS))
    return rounded(scores, *EMOTION_COLUMNS)


@query("emotion_shares", f"SELECT doc_id, {q6(*EMOTION_COLUMNS)} FROM shares")
def emotion_shares(spark, sf):
    return rounded(mood.emotion_shares(w.scored_documents(spark, sf)), *EMOTION_COLUMNS)


@query("scored_share", f"""SELECT fixture_id, round_even(avg(CASE WHEN {EMO_SUM} > 0 THEN 1.0 ELSE 0.0 END), 4) AS coverage
    FROM shared GROUP BY 1""")
def scored_share(spark, sf):
    return mood.scored_share(w.shared_chat(spark, sf))


@query("minute_profile", f"SELECT fixture_id, minute, {q6(*EMOTION_COLUMNS)}, CAST(comment_volume AS BIGINT) AS comment_volume FROM prof")
def minute_profile(spark, sf):
    return rounded(mood.dense_profile(mood.minute_means(w.shared_chat(spark, sf))), *EMOTION_COLUMNS)


@query("profile_panic", f"""SELECT fixture_id, minute, {s6(f'tanh(2 * ({BALANCE}))')} AS panic,
    {dominant_sql()} AS dominant_emotion FROM prof""")
def profile_panic(spark, sf):
    profile = mood.dense_profile(mood.minute_means(w.shared_chat(spark, sf)))
    return profile.select(
        "fixture_id", "minute", r6(mood.panic_from_shares()).alias("panic"),
        mood.dominant_emotion().alias("dominant_emotion"),
    )


@query("simple_series", f"""SELECT fixture_id, minute, {s6(f'avg(p) OVER ({PER_FIXTURE} ROWS 4 PRECEDING)')} AS crowd_panic_score
    FROM (SELECT fixture_id, minute, {ffill('panic', '0')} AS p FROM
      (SELECT fixture_id, unnest(range(0, max(minute) + 1)) AS minute FROM timed GROUP BY 1) LEFT JOIN
      (SELECT fixture_id, minute, avg(x) AS panic FROM timed JOIN (
        SELECT doc_id, tanh({term_sum('low', w.PANIC)}) AS x FROM (SELECT doc_id, lower(text) AS low FROM documents)
      ) USING (doc_id) GROUP BY ALL) USING (fixture_id, minute))""")
def simple_series(spark, sf):
    scored = lexicon.panic_score(w.documents(spark, sf), "text", w.PANIC).select("doc_id", "panic")
    timed = posts_to_chat(w.posts(spark, sf), w.fixtures(spark, sf))
    return rounded(mood.simple_series_from_scores(timed.join(scored, "doc_id")), "crowd_panic_score")


@query("emotion_series", f"""SELECT fixture_id, minute, {q6(*SERIES_COLUMNS)}, CAST(comment_volume AS BIGINT) AS comment_volume,
    dominant_emotion FROM series""")
def emotion_series(spark, sf):
    return rounded(mood_series(spark, sf), *SERIES_COLUMNS)


@query("volatility", f"SELECT fixture_id, minute, {q6('emotional_volatility')} FROM series")
def volatility(spark, sf):
    profile = mood.dense_profile(mood.minute_means(w.shared_chat(spark, sf)))
    return mood.with_volatility(profile).select("fixture_id", "minute", r6("emotional_volatility"))


@query("match_events", "SELECT fixture_id, seq, minute, team, event_type, xg_value FROM mev")
def match_events(spark, sf):
    return threat.parse_commentary(w.commentary(spark, sf))


@query("quarantined_lines", """SELECT fixture_id, seq, '7777' || line AS line, 'impossible minute' AS reason FROM lines WHERE seq % 13 = 0""")
def quarantined_lines(spark, sf):
    return threat.quarantined_lines(_poisoned(spark, sf))


@query("poisoned_threat", f"""SELECT fixture_id, minute, {q6('xg_value')} FROM (
    SELECT c.fixture_id, c.minute, coalesce(x, 0) AS xg_value
    FROM (SELECT fixture_id, unnest(range(0, max(minute) + 1)) AS minute FROM mev WHERE seq % 13 <> 0 GROUP BY 1) c
    LEFT JOIN (SELECT fixture_id, minute, sum(xg_value) AS x FROM mev WHERE seq % 13 <> 0 GROUP BY ALL) m USING (fixture_id, minute))""")
def poisoned_threat(spark, sf):
    """Misread stamps cost their own lines and nothing else."""
    return rounded(threat.minute_xg(threat.parse_commentary(_poisoned(spark, sf))), "xg_value")


def _poisoned(spark, sf):
    """Commentary in which every thirteenth line's stamp is misread."""
    misread = F.when(F.pmod("seq", F.lit(13)) == 0, F.concat(F.lit("7777"), "line")).otherwise(F.col("line"))
    return w.commentary(spark, sf).withColumn("line", misread)


@query("minute_xg", f"SELECT fixture_id, minute, {q6('xg_value')} FROM mxg")
def minute_xg(spark, sf):
    return rounded(threat.minute_xg(threat.parse_commentary(w.commentary(spark, sf))), "xg_value")


@query("rolling_threat", f"SELECT fixture_id, minute, {q6('rolling_xg', 'delta_xg_10min')} FROM threat")
def rolling_threat(spark, sf):
    return rounded(threat.threat_series(w.commentary(spark, sf)), "rolling_xg", "delta_xg_10min")


STATE_NUMBERS = ["crowd_panic_score", "rolling_xg", "delta_xg_10min", "arbitrage_index"]


@query("arbitrage_state", f"SELECT fixture_id, minute, {q6(*STATE_NUMBERS)}, flagged FROM st")
def arbitrage_state(spark, sf):
    return rounded(state(spark, sf), *STATE_NUMBERS).select("fixture_id", "minute", *STATE_NUMBERS, "flagged")


@query("flagged_minutes", f"""SELECT fixture_id, minute, {q6('crowd_panic_score', 'delta_xg_10min', 'arbitrage_index')}
    FROM st WHERE flagged""")
def flagged_minutes(spark, sf):
    """Which minutes of which fixtures show mood out of line with events."""
    moments = state(spark, sf).filter("flagged")
    return rounded(moments, *STATE_NUMBERS).select(
        "fixture_id", "minute", "crowd_panic_score", "delta_xg_10min", "arbitrage_index"
    )


@query("filled_state", f"""SELECT fixture_id, minute, {q6(*EMOTION_COLUMNS, 'emotional_volatility')},
    CAST(comment_volume AS BIGINT) AS comment_volume, dominant_emotion FROM st""")
def filled_state(spark, sf):
    columns = [*EMOTION_COLUMNS, "emotional_volatility"]
    return rounded(state(spark, sf), *columns).select(
        "fixture_id", "minute", *columns, "comment_volume", "dominant_emotion"
    )


@query("situations", "SELECT fixture_id, minute, situation, situation_confidence FROM cls")
def situations(spark, sf):
    return classified(spark, sf).select("fixture_id", "minute", "situation", "situation_confidence")


@query("situation_briefs", "SELECT situation, " + "CASE situation " + " ".join(
    f"WHEN '{p[0]}' THEN '{p[1]}'" for p in situation.PLAYBOOK) + " END AS label, CASE situation " + " ".join(
    "WHEN '{}' THEN '{}'".format(p[0], ",".join(p[2])) for p in situation.PLAYBOOK) + """ END AS metrics,
    count(*) AS minutes FROM cls GROUP BY ALL""")
def situation_briefs(spark, sf):
    counted = classified(spark, sf).groupBy("situation").agg(F.count(F.lit(1)).alias("minutes"))
    return situation.with_brief(counted).select(
        "situation", "label", F.array_join("metrics", ",").alias("metrics"), "minutes"
    )


_METRICS_SQL = " UNION ALL ".join(
    f"SELECT '{p[0]}' AS situation, CAST({i} AS INTEGER) AS position, '{m}' AS metric, '{situation.METRIC_LABELS[m]}' AS label"
    for p in situation.PLAYBOOK for i, m in enumerate(p[2])
)
_METRIC_VALUE = "CASE metric " + " ".join(f"WHEN '{m}' THEN CAST({m} AS DOUBLE)" for m in situation.METRIC_LABELS) + " END"


@query("key_metrics", f"""SELECT fixture_id, situation, position, metric, label, {s6(_METRIC_VALUE)} AS value
    FROM latest JOIN ({_METRICS_SQL}) USING (situation)""")
def key_metrics(spark, sf):
    return rounded(situation.key_metrics(classified(spark, sf)), "value")


@query("latest_minute", f"SELECT fixture_id, minute, {q6(*STATE_NUMBERS)}, dominant_emotion, situation FROM latest")
def latest_minute(spark, sf):
    return rounded(latest(classified(spark, sf)), *STATE_NUMBERS).select(
        "fixture_id", "minute", *STATE_NUMBERS, "dominant_emotion", "situation"
    )


@query("top_flags", f"""SELECT fixture_id, minute, {q6('arbitrage_index')}, CAST(position AS INTEGER) AS position
    FROM (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY arbitrage_index DESC, minute) AS position
          FROM st WHERE flagged) WHERE position <= 4""")
def top_flags(spark, sf):
    ranked = selector.flagged_by_index(state(spark, sf), 4)
    return rounded(ranked, "arbitrage_index").select("fixture_id", "minute", "arbitrage_index", "position")


@query("flag_counts", "SELECT fixture_id, CAST(sum(CASE WHEN flagged THEN 1 ELSE 0 END) AS BIGINT) AS flagged_minutes FROM st GROUP BY 1")
def flag_counts(spark, sf):
    return selector.flag_counts(state(spark, sf))


_CHANGES = ["crowd_panic_score", "delta_xg_10min", "arbitrage_index"]


@query("minute_change", "SELECT fixture_id, minute, " + q6(*_CHANGES, *[f"{c}_change" for c in _CHANGES])
       + " FROM (SELECT *, " + ", ".join(
           f"coalesce({c} - lag({c}) OVER ({PER_FIXTURE}), 0) AS {c}_change" for c in _CHANGES)
       + ", row_number() OVER (PARTITION BY fixture_id ORDER BY minute DESC) AS rn FROM st) WHERE rn = 1")
def minute_change(spark, sf):
    return rounded(selector.minute_change(state(spark, sf)), *_CHANGES, *[f"{c}_change" for c in _CHANGES])


@query("last_minutes", "SELECT fixture_id, max(minute) AS last_minute FROM timed GROUP BY 1")
def last_minutes(spark, sf):
    timed = posts_to_chat(w.posts(spark, sf), w.fixtures(spark, sf))
    return timed.groupBy("fixture_id").agg(F.max("minute").alias("last_minute"))
