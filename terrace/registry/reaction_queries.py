"""Cleaning, de-duplication, buffers, attribution, health and back-fill."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrace import workload as w
from terrace.functions.text import message_key, normalised
from terrace.operators import archive, attribution, backfill, cleaning, containment, health
from terrace.operators.minutes import posts_to_chat
from terrace.registry.base import (
    AS_OF, EMO_SUM, MENTION, URL, VIEWS, WS, dominant_sql, literal, query,
)
from terrace.schemas import EMOTION_COLUMNS

BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"

_STRIPPED = f"regexp_replace(regexp_replace(text, {literal(URL)}, ' ', 'g'), {literal(MENTION)}, ' ', 'g')"
_TOPIC = " OR ".join(f"contains(lower(text), {literal(t)})" for t in cleaning.TOPIC_WORDS)

VIEWS.update({
    "chars": f"""SELECT doc_id, text, string_split(t, '') AS cs FROM (SELECT doc_id, text,
        regexp_replace(regexp_replace(lower(text), {literal(URL)}, ' ', 'g'), {literal(MENTION)}, ' ', 'g') AS t FROM documents)""",
    "doc_flags": f"""SELECT doc_id, text,
        trim(regexp_replace(array_to_string(list_filter(cs, lambda c, i: NOT coalesce(i > 2 AND c <> chr(10)
            AND c = cs[i - 1] AND c = cs[i - 2], false)), ''), {literal(WS + '+')}, ' ', 'g')) AS norm,
        len(regexp_extract_all({_STRIPPED}, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]{{2,}}')) >= 3 AS readable,
        {_TOPIC} AS topical FROM chars""",
    "gated": """SELECT p.*, d.norm, d.text FROM posts p JOIN doc_flags d USING (doc_id) JOIN fx USING (fixture_id)
        WHERE author NOT LIKE '%bot' AND readable
        AND (contains(lower(d.text), lower(home_team)) OR contains(lower(d.text), lower(away_team)) OR topical)""",
    "uniq": "SELECT * FROM gated QUALIFY row_number() OVER (PARTITION BY fixture_id, norm ORDER BY ingest_seq) = 1",
    "cleaned": "SELECT * FROM uniq QUALIFY row_number() OVER (PARTITION BY fixture_id, author ORDER BY ingest_seq) <= 5",
    "doc_sides": " UNION ALL ".join(
        f"SELECT doc_id, {literal(t)} AS team_name, contains(lower(text), {literal(t.lower())}) AS said FROM documents"
        for t in w.TEAMS
    ),
    "tagged": """SELECT t.*, CASE WHEN h.said AND a.said THEN 'both' WHEN h.said THEN 'home' WHEN a.said THEN 'away'
        ELSE 'neither' END AS team FROM timed t JOIN fx USING (fixture_id)
        JOIN doc_sides h ON h.doc_id = t.doc_id AND h.team_name = home_team
        JOIN doc_sides a ON a.doc_id = t.doc_id AND a.team_name = away_team""",
    "side_rows": f"""SELECT g.*, unnest(CASE team WHEN 'both' THEN ['home', 'away'] WHEN 'neither' THEN [] ELSE [team] END) AS side
        FROM tagged g""",
    "side0": "SELECT fixture_id, side, " + ", ".join(f"avg({c}) AS {c}" for c in EMOTION_COLUMNS)
        + f""", count(*) AS volume, round_even(avg(CASE WHEN {EMO_SUM} > 0 THEN 1.0 ELSE 0.0 END), 4) AS coverage
        FROM side_rows JOIN shares USING (doc_id) GROUP BY ALL""",
    "side_mood": f"""SELECT fixture_id, side, team, {dominant_sql()} AS dominant, """
        + ", ".join(f"round_even({c}, 4) AS {c}" for c in EMOTION_COLUMNS) + """, volume, coverage FROM (
        SELECT x.fixture_id, x.side, x.team, """
        + ", ".join(f"coalesce({c}, 0) AS {c}" for c in EMOTION_COLUMNS)
        + """, coalesce(volume, 0) AS volume, coalesce(coverage, 0) AS coverage FROM (
            SELECT fixture_id, 'home' AS side, home_team AS team FROM fx UNION ALL
            SELECT fixture_id, 'away', away_team FROM fx) x LEFT JOIN side0 USING (fixture_id, side))""",
})


def _with_terms(spark, sf):
    terms = w.fixtures(spark, sf).select("fixture_id", F.array("home_team", "away_team").alias("terms"))
    return w.reactions(spark, sf).join(terms, "fixture_id")


def _tagged(spark, sf, df=None):
    timed = posts_to_chat(w.reactions(spark, sf) if df is None else df, w.fixtures(spark, sf))
    return attribution.tag_teams(timed, w.fixtures(spark, sf))


def side_moods(spark, sf):
    """Tag and score every text once, then spread both over the posts."""
    shared = w.shared_chat(spark, sf)
    texts = w.documents(spark, sf).select("doc_id", F.col("text").alias("message"))
    fixtures = w.fixtures(spark, sf)
    tagged = attribution.tag_teams(shared.join(texts, "doc_id"), fixtures)
    return attribution.side_mood(tagged.drop("message"), fixtures)


@query("normalised_text", "SELECT doc_id, substr(sha256(norm), 1, 24) AS key FROM doc_flags")
def normalised_text(spark, sf):
    return w.documents(spark, sf).select("doc_id", F.substring(F.sha2(normalised(F.col("text")), 256), 1, 24).alias("key"))


@query("readable", "SELECT doc_id, readable FROM doc_flags")
def readable(spark, sf):
    return w.documents(spark, sf).select("doc_id", cleaning.is_readable(F.col("text")).alias("readable"))


@query("fan_authors", """SELECT author, count(*) AS posts FROM posts WHERE author NOT LIKE '%bot' AND author NOT IN ("""
       + ", ".join(literal(b) for b in cleaning.BOT_AUTHORS) + ") GROUP BY 1")
def fan_authors(spark, sf):
    return w.posts(spark, sf).filter(cleaning.is_fan(F.col("author"))).groupBy("author").agg(F.count(F.lit(1)).alias("posts"))


@query("relevant", """SELECT ingest_seq, contains(lower(text), lower(home_team)) OR contains(lower(text), lower(away_team)) OR topical
    AS relevant FROM posts JOIN doc_flags USING (doc_id) JOIN fx USING (fixture_id)""")
def relevant(spark, sf):
    return _with_terms(spark, sf).select(
        "ingest_seq", cleaning.is_relevant(F.col("message"), F.col("terms")).alias("relevant")
    )


@query("distinct_messages", """SELECT fixture_id, ingest_seq, doc_id FROM posts JOIN doc_flags USING (doc_id)
    QUALIFY row_number() OVER (PARTITION BY fixture_id, norm ORDER BY ingest_seq) = 1""")
def distinct_messages(spark, sf):
    return cleaning.drop_copies(w.reactions(spark, sf)).select("fixture_id", "ingest_seq", "doc_id")


@query("author_cap", """SELECT fixture_id, author, ingest_seq FROM posts
    QUALIFY row_number() OVER (PARTITION BY fixture_id, author ORDER BY ingest_seq) <= 2""")
def author_cap(spark, sf):
    return cleaning.cap_authors(w.posts(spark, sf), 2).select("fixture_id", "author", "ingest_seq")


@query("clean_reactions", "SELECT fixture_id, ingest_seq, author, doc_id FROM cleaned")
def clean_reactions(spark, sf):
    return cleaning.clean_reactions(_with_terms(spark, sf), "terms").select("fixture_id", "ingest_seq", "author", "doc_id")


@query("newest_reactions", """SELECT fixture_id, ingest_seq FROM posts
    QUALIFY row_number() OVER (PARTITION BY fixture_id ORDER BY created_utc DESC, ingest_seq DESC) <= 10""")
def newest_reactions(spark, sf):
    return cleaning.newest(w.posts(spark, sf), 10).select("fixture_id", "ingest_seq")


@query("newest_by_source", """SELECT source, ingest_seq FROM posts
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY created_utc DESC, ingest_seq DESC) <= 1500""")
def newest_by_source(spark, sf):
    """Ranks beyond Spark's group limit, over few and large groups."""
    return cleaning.newest(w.posts(spark, sf), 1500, ("source",)).select("source", "ingest_seq")


@query("last_thirty", """SELECT fixture_id, ingest_seq FROM cleaned
    QUALIFY row_number() OVER (PARTITION BY fixture_id ORDER BY created_utc DESC, ingest_seq DESC) <= 30""")
def last_thirty(spark, sf):
    kept = cleaning.clean_reactions(_with_terms(spark, sf), "terms")
    return cleaning.newest(kept, 30).select("fixture_id", "ingest_seq")


@query("union_sources", """SELECT source, CAST(CASE source WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS INTEGER) AS source_rank,
    count(*) AS n FROM posts GROUP BY ALL""")
def union_sources(spark, sf):
    posts = w.posts(spark, sf)
    merged = cleaning.union_sources([posts.filter(F.col("source") == s) for s in ("click", "view", "signup")])
    return merged.groupBy("source", "source_rank").agg(F.count(F.lit(1)).alias("n"))


@query("buffer_merge", """SELECT fixture_id, ingest_seq FROM (SELECT * FROM (
      SELECT p.*, CASE WHEN created_utc < kickoff_utc + INTERVAL 50 MINUTE THEN 0 ELSE 1 END AS s, d.norm
      FROM posts p JOIN doc_flags d USING (doc_id) JOIN fx USING (fixture_id))
    QUALIFY row_number() OVER (PARTITION BY fixture_id, norm ORDER BY s, ingest_seq) = 1)
    QUALIFY row_number() OVER (PARTITION BY fixture_id ORDER BY created_utc DESC, s DESC, ingest_seq DESC) <= 12""")
def buffer_merge(spark, sf):
    """Buffer of the first 50 minutes merged with the tick after it."""
    kickoffs = w.fixtures(spark, sf).select("fixture_id", "kickoff_utc")
    rows = w.reactions(spark, sf).join(kickoffs, "fixture_id")
    early = F.col("created_utc") < F.col("kickoff_utc") + F.expr("INTERVAL 50 MINUTES")
    merged = cleaning.merge_buffer(rows.filter(early), rows.filter(~early), 12)
    return merged.select("fixture_id", "ingest_seq")


@query("team_tokens", """SELECT fixture_id, lower(home_team) AS home_tokens, lower(away_team) AS away_tokens FROM fx""")
def team_tokens(spark, sf):
    tokens = attribution.with_tokens(w.fixtures(spark, sf))
    return tokens.select(
        "fixture_id", F.array_join("_home", ",").alias("home_tokens"), F.array_join("_away", ",").alias("away_tokens")
    )


@query("team_tags", "SELECT ingest_seq, team FROM tagged")
def team_tags(spark, sf):
    return _tagged(spark, sf).select("ingest_seq", "team")


@query("side_subset", "SELECT ingest_seq, minute FROM tagged WHERE team IN ('away', 'both')")
def side_subset(spark, sf):
    return attribution.reactions_of_side(_tagged(spark, sf), "away").select("ingest_seq", "minute")


@query("tag_counts", "SELECT fixture_id, team, count(*) AS n FROM tagged GROUP BY ALL")
def tag_counts(spark, sf):
    return attribution.tag_counts(_tagged(spark, sf))


@query("attribution_coverage", """SELECT fixture_id, round_even(avg(CASE WHEN team <> 'neither' THEN 1.0 ELSE 0.0 END), 4) AS attributed
    FROM tagged GROUP BY 1""")
def attribution_coverage(spark, sf):
    return attribution.attribution_coverage(_tagged(spark, sf))


@query("side_mood", f"SELECT fixture_id, side, team, dominant, {', '.join(EMOTION_COLUMNS)}, CAST(volume AS BIGINT) AS volume, coverage FROM side_mood")
def side_mood(spark, sf):
    return side_moods(spark, sf)


@query("term_semi_join", "SELECT doc_id FROM documents WHERE " + " OR ".join(f"contains(lower(text), {literal(t.lower())})" for t in w.TEAMS))
def term_semi_join(spark, sf):
    """Texts naming any team of the fixtures table."""
    fixtures = w.fixtures(spark, sf)
    terms = fixtures.select(F.lower("home_team").alias("term")).union(fixtures.select(F.lower("away_team"))).distinct()
    texts = w.documents(spark, sf).select("doc_id", F.lower("text").alias("low"))
    return containment.semi_contains(texts, "low", terms, "term", "doc_id").select("doc_id")


@query("reaction_keys", f"SELECT doc_id, substr(sha256(trim(text, {BLANKS})), 1, 24) AS message_hash FROM documents")
def reaction_keys(spark, sf):
    return w.documents(spark, sf).select("doc_id", message_key(F.col("text")).alias("message_hash"))


@query("stored_reactions", f"""SELECT fixture_id AS match_id, substr(sha256(trim(text, {BLANKS})), 1, 24) AS message_hash, minute, tagged.source, team, author
    FROM tagged JOIN documents USING (doc_id)
    QUALIFY row_number() OVER (PARTITION BY fixture_id, trim(text, {BLANKS}) ORDER BY ingest_seq) = 1""")
def stored_reactions(spark, sf):
    return archive.stored_reactions(_tagged(spark, sf)).drop("message")


@query("source_counts", "SELECT fixture_id, source, count(*) AS n FROM timed GROUP BY ALL")
def source_counts(spark, sf):
    return health.source_counts(posts_to_chat(w.posts(spark, sf), w.fixtures(spark, sf)))


VIEWS["src"] = "SELECT fixture_id, source, count(*) AS n FROM timed GROUP BY ALL"
VIEWS["hb"] = f"""SELECT fixture_id AS match_id, strftime(TIMESTAMP '{AS_OF}', '%Y-%m-%dT%H:%M:%S+00:00') AS last_run_utc,
    'live' AS source, true AS live, coalesce(n_reactions, 0) AS n_reactions, coalesce(n_commentary, 0) AS n_commentary,
    coalesce(listed, '') AS listed, coalesce(n_commentary, 0) > 0 AS fetch_ok, kickoff_utc
    FROM fx LEFT JOIN (SELECT fixture_id, sum(n)::BIGINT AS n_reactions,
        string_agg(source || ' ' || CAST(n AS VARCHAR), ', ' ORDER BY n DESC, source) AS listed FROM src GROUP BY 1) USING (fixture_id)
    LEFT JOIN (SELECT fixture_id, count(*) AS n_commentary FROM lines GROUP BY 1) USING (fixture_id)"""


def heartbeats(spark, sf):
    fixtures = w.fixtures(spark, sf)
    chat = posts_to_chat(w.posts(spark, sf), fixtures)
    return health.run_health(chat, w.commentary(spark, sf), fixtures, F.lit(AS_OF).cast("timestamp"))


@query("run_health", """SELECT match_id, last_run_utc, source, live, n_reactions, n_commentary, listed AS reactions_by_source, fetch_ok FROM hb""")
def run_health(spark, sf):
    return listed_sources(heartbeats(spark, sf))


def listed_sources(beats):
    parts = F.transform(F.map_entries("reactions_by_source"), lambda e: F.concat(e["key"], F.lit(" "), e["value"].cast("string")))
    return beats.withColumn("reactions_by_source", F.array_join(parts, ", "))


@query("freshness", """SELECT match_id, CASE WHEN n_reactions = 0 THEN 'no-data' WHEN age > 25 THEN 'stale' ELSE 'live' END AS level,
    CASE WHEN n_reactions = 0 THEN 'No data' WHEN age > 25 THEN 'Stale' ELSE 'Live capture' END AS label,
    CASE WHEN n_reactions = 0 THEN 'No captured engine state yet.'
      WHEN age > 25 THEN 'Last live capture ' || age || ' min ago — between matches or the feed is delayed.'
      ELSE n_reactions || ' reactions (' || listed || '); updated ' || age || ' min ago.' END AS detail
    FROM (SELECT *, n_commentary * 4 AS age FROM hb)""")
def freshness(spark, sf):
    """Heartbeats aged by four minutes per commentary line, so that every level occurs."""
    as_of = F.lit(AS_OF).cast("timestamp")
    aged = heartbeats(spark, sf).withColumn(
        "last_run_utc",
        F.date_format(F.timestamp_seconds(F.unix_seconds(as_of) - F.col("n_commentary") * 240), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
    )
    return health.freshness(aged, as_of)


@query("fixture_source", """SELECT slot AS slot, CASE slot % 4 WHEN 0 THEN 'live' WHEN 1 THEN 'feed' WHEN 2 THEN 'simulator' ELSE 'unknown' END AS source FROM fx""")
def fixture_source(spark, sf):
    prefix = F.element_at(F.array(*[F.lit(p) for p in ("ESPN-", "FEED-", "SIM-", "NONE-")]), (F.pmod("slot", F.lit(4)) + 1).cast("int"))
    return w.fixtures(spark, sf).select("slot", health.fixture_source(F.concat(prefix, F.col("slot").cast("string"))).alias("source"))


_NOW = "TIMESTAMP '2024-01-16 12:30:00'"


@query("capture_phase", f"""SELECT fixture_id, CASE WHEN state = 'pre' THEN 'pre' WHEN state = 'in' THEN 'live'
    WHEN {_NOW} >= kickoff_utc + INTERVAL 135 MINUTE THEN 'frozen' WHEN {_NOW} >= kickoff_utc + INTERVAL 180 MINUTE THEN 'frozen'
    ELSE 'post-window' END AS phase FROM fx""")
def capture_phase(spark, sf):
    seen = F.col("kickoff_utc") + F.expr("INTERVAL 120 MINUTES")
    now = F.lit("2024-01-16 12:30:00").cast("timestamp")
    return w.fixtures(spark, sf).select(
        "fixture_id", health.capture_phase(F.col("state"), F.col("kickoff_utc"), now, seen).alias("phase")
    )


@query("capture_pick", f"""SELECT fixture_id, state FROM fx WHERE state = 'in' OR (state = 'post' AND {_NOW} < kickoff_utc + INTERVAL 180 MINUTE)
    ORDER BY CASE WHEN state = 'in' THEN 0 ELSE 1 END, slot LIMIT 1""")
def capture_pick(spark, sf):
    board = w.fixtures(spark, sf).withColumn("feed_order", F.col("slot"))
    return health.capture_pick(board, F.lit("2024-01-16 12:30:00").cast("timestamp")).select("fixture_id", "state")


@query("live_pick", "SELECT fixture_id, state FROM fx WHERE state = 'in' ORDER BY slot LIMIT 1")
def live_pick(spark, sf):
    return health.live_pick(w.fixtures(spark, sf).withColumn("feed_order", F.col("slot"))).select("fixture_id", "state")


@query("fixtures_by_kickoff", "SELECT fixture_id, CAST(row_number() OVER (ORDER BY kickoff_utc) AS BIGINT) AS position FROM fx")
def fixtures_by_kickoff(spark, sf):
    """Kickoff order as a position, counted per day first so that no task sees all fixtures."""
    from pyspark.sql import Window

    day = F.floor(F.unix_seconds("kickoff_utc") / 86400)
    keyed = w.fixtures(spark, sf).withColumn("day", day)
    days = keyed.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    before = days.withColumn(
        "earlier", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    inside = F.row_number().over(Window.partitionBy("day").orderBy("kickoff_utc"))
    return keyed.withColumn("inside", inside).join(before.select("day", "earlier"), "day").select(
        "fixture_id", (F.col("earlier") + F.col("inside")).alias("position")
    )


VIEWS.update({
    "bf": """SELECT f.fixture_id, p.created_utc, p.source, p.author, p.ingest_seq, p.doc_id, f.kickoff_utc FROM
        (SELECT * EXCLUDE (fixture_id) FROM posts) p JOIN fx f
        ON p.created_utc >= f.kickoff_utc - INTERVAL 15 MINUTE AND p.created_utc <= f.kickoff_utc + INTERVAL 130 MINUTE
        JOIN doc_sides h ON h.doc_id = p.doc_id AND h.team_name = home_team
        JOIN doc_sides a ON a.doc_id = p.doc_id AND a.team_name = away_team
        WHERE h.said OR a.said""",
})


def historic_matches(spark, sf):
    return backfill.match_to_fixtures(w.posts(spark, sf).drop("fixture_id"), w.fixtures(spark, sf), w.messages(spark, sf))


@query("backfill_matches", "SELECT fixture_id, ingest_seq FROM bf")
def backfill_matches(spark, sf):
    return historic_matches(spark, sf).select("fixture_id", "ingest_seq")
