"""Landed payloads to typed rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrace import landed
from terrace import workload as w
from terrace.functions.text import message_key
from terrace.registry.base import AS_OF, VIEWS, place_number, q6, query, rounded
from terrace.registry.reaction_queries import BLANKS
from terrace.sources import detail, fixtures, posts, tables

# Values that the landed payloads carry, restated over the raw tables.
VIEWS.update({
    "txt": f"""SELECT e.*, 'u' || CAST(user_id AS VARCHAR) AS author, substr(sha256(trim(d.text, {BLANKS})), 1, 24) AS key,
        d.text, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN epoch_us(ts) // 1000 * 1000
        WHEN event_id % 3 = 1 THEN epoch_us(ts) // 60000000 * 60000000 ELSE epoch_us(ts) END AS micros
        FROM ev e JOIN documents d ON d.doc_id = event_id % (SELECT count(*) FROM documents)""",
    "sided": "SELECT *, CASE WHEN event_id % 2 = 1 THEN 0 ELSE 1 END AS side FROM ev",
    "counts": """SELECT fixture_id, side, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS shots,
        count(*) FILTER (event_type = 'purchase' AND event_id % 5 < 2) AS target, count(*) FILTER (event_type = 'error') AS saves
        FROM sided GROUP BY ALL""",
    "two_sides": "SELECT fx.fixture_id, s.side, CASE WHEN s.side = 0 THEN home_team ELSE away_team END AS team FROM fx, (VALUES (0), (1)) s(side)",
    "tstats": """SELECT fixture_id, side AS team_order, team, unnest(['possessionPct', 'totalShots', 'shotsOnTarget', 'saves']) AS stat,
        unnest([CAST(100 * coalesce(n, 0) // t AS VARCHAR) || '%', CAST(coalesce(shots, 0) AS VARCHAR),
            CAST(coalesce(target, 0) AS VARCHAR), CAST(coalesce(saves, 0) AS VARCHAR)]) AS value
        FROM two_sides LEFT JOIN counts USING (fixture_id, side) JOIN (SELECT fixture_id, count(*) AS t FROM ev GROUP BY 1) USING (fixture_id)""",
    "players": """SELECT fixture_id, side AS team_order, team, user_id AS roster_order, 'P' || CAST(user_id AS VARCHAR) AS name,
        CASE WHEN user_id % 11 = 0 THEN 'G' ELSE 'F' END AS position, user_id % 2 = 0 AS starter, shots, saves, faced, conceded
        FROM (SELECT fixture_id, side, user_id, CAST(count(*) FILTER (event_type = 'purchase') AS DOUBLE) AS shots,
          CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) AS saves, CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) AS faced,
          CAST(count(*) FILTER (event_type = 'view') AS DOUBLE) AS conceded FROM sided GROUP BY ALL)
        JOIN two_sides USING (fixture_id, side) WHERE user_id % 13 <> 0""",
    "tops": " UNION ALL ".join(
        f"""SELECT fixture_id, team, '{c}' AS category, 'P' || CAST(user_id AS VARCHAR) || ' (' || CAST(n AS VARCHAR) || ')' AS leader FROM
        (SELECT fixture_id, side, user_id, count(*) FILTER (event_type = '{k}') AS n FROM sided GROUP BY fixture_id, side, user_id
         QUALIFY row_number() OVER (PARTITION BY fixture_id, side ORDER BY n DESC, user_id DESC) = 1)
        JOIN two_sides USING (fixture_id, side) WHERE n > 0"""
        for c, k in {"totalShots": "purchase", "saves": "error", "accuratePasses": "click"}.items()
    ),
    "kev": """SELECT * FROM (SELECT fixture_id, event_id AS event_order,
        CAST(greatest(epoch_us(ts) // 1000000 - epoch_us(kickoff_utc) // 1000000, 0) // 60 AS BIGINT) AS minute,
        (['goal', 'yellow-card', 'penalty--scored', '', 'own-goal', 'substitution'])[event_id % 6 + 1] AS type,
        CASE WHEN event_id % 2 = 1 THEN home_team ELSE away_team END AS team,
        CASE WHEN event_id % 4 = 0 THEN 'scored by u' || CAST(user_id AS VARCHAR) ELSE '' END AS text
        FROM ev JOIN fx USING (fixture_id)) WHERE type <> ''""",
    "prices": """SELECT l_partkey AS event_id, l_orderkey * 10 + l_linenumber AS pos, l_returnflag AS outcome,
        1.0 + l_extendedprice / 10000.0 AS price FROM lineitem
        WHERE l_linenumber <> 7 AND (l_linestatus = 'O' OR l_linenumber <= 4)""",
})


def _reactions(df):
    return df.select(
        "fixture_id", F.col("ingest_seq.payload_order").alias("position"),
        F.unix_micros("created_utc").alias("micros"), message_key(F.col("message")).alias("key"), "source", "author",
    )


def _first(kind: str, source: str) -> str:
    return f"""SELECT fixture_id, event_id AS position, micros, key, '{source}' AS source, author FROM (
        SELECT * FROM txt WHERE event_type = '{kind}'
        QUALIFY row_number() OVER (PARTITION BY fixture_id, event_id // 3 ORDER BY event_id) = 1) WHERE micros IS NOT NULL"""


_PLAIN = {
    "post_pages": _first("click", "bluesky"),
    "tag_timelines": _first("view", "mastodon").replace("micros, key,", f"""micros,
    substr(sha256(trim(regexp_replace('<p>' || text || '</p>', '<[^>]+>', ' ', 'g'), {BLANKS})), 1, 24) AS key,"""),
    "thread_comments": """SELECT fixture_id, event_id AS position, epoch_us(ts) // 1000000 * 1000000 AS micros, key, 'reddit' AS source, author
    FROM txt WHERE event_type = 'purchase' AND event_id % 2 = 0 AND event_id % 5 <> 0""",
    "live_chat": """SELECT fixture_id, event_id AS position, micros, key, 'youtube' AS source, author FROM txt
    WHERE event_type = 'signup' AND micros IS NOT NULL""",
    "search_answers": f"""SELECT fixture_id, event_id AS position, coalesce(micros, epoch_us(TIMESTAMP '{AS_OF}')) AS micros, key,
    'x' AS source, author FROM txt WHERE event_type = 'error' AND event_id % 4 <> 0""",
}


@query("post_pages", _PLAIN["post_pages"])
def post_pages(spark, sf):
    return _reactions(posts.post_pages(landed.post_pages(spark, sf)))


@query("tag_timelines", _PLAIN["tag_timelines"])
def tag_timelines(spark, sf):
    return _reactions(posts.tag_timelines(landed.tag_timelines(spark, sf)))


@query("thread_comments", _PLAIN["thread_comments"])
def thread_comments(spark, sf):
    threads = posts.match_threads(landed.thread_searches(spark, sf))
    return _reactions(posts.thread_comments(landed.thread_comments(spark, sf), threads))


@query("live_chat", _PLAIN["live_chat"])
def live_chat(spark, sf):
    return _reactions(posts.live_chat(landed.live_chat(spark, sf)))


@query("search_answers", _PLAIN["search_answers"])
def search_answers(spark, sf):
    return _reactions(posts.search_answers(landed.search_answers(spark, sf), F.lit(AS_OF).cast("timestamp")))


_GATHERED = [("post_pages", 0), ("tag_timelines", 1), ("thread_comments", 2), ("live_chat", 3), ("search_answers", 4)]


@query("gathered_sources", " UNION ALL ".join(f"SELECT fixture_id, {rank} AS source_rank, position, micros, key, source, author FROM ({_PLAIN[name]})" for name, rank in _GATHERED))
def gathered_sources(spark, sf):
    threads = posts.match_threads(landed.thread_searches(spark, sf))
    merged = posts.gather([
        posts.post_pages(landed.post_pages(spark, sf)), posts.tag_timelines(landed.tag_timelines(spark, sf)),
        posts.thread_comments(landed.thread_comments(spark, sf), threads), posts.live_chat(landed.live_chat(spark, sf)),
        posts.search_answers(landed.search_answers(spark, sf), F.lit(AS_OF).cast("timestamp")),
    ])
    place = F.col("ingest_seq")
    return merged.select(
        "fixture_id", place["source_rank"].alias("source_rank"), place["place"]["payload_order"].alias("position"),
        F.unix_micros("created_utc").alias("micros"), message_key(F.col("message")).alias("key"), "source", "author",
    )


@query("scoreboard", """SELECT CAST(slot AS VARCHAR) AS event_id, away_team || ' at ' || home_team AS name,
    upper(away_team) || ' @ ' || upper(home_team) AS short_name, epoch_us(kickoff_utc) AS kickoff_micros, state,
    CAST(slot % 97 AS BIGINT) AS clock_minute, home_team, away_team, score FROM fx""")
def scoreboard(spark, sf):
    board = fixtures.scoreboard(landed.scoreboards(spark, sf))
    return board.withColumn("kickoff_micros", F.unix_micros("kickoff_utc")).drop("kickoff_utc", "feed_order")


@query("commentary_lines", """SELECT fixture_id, -seq * 1000000 AS seq,
    regexp_extract(line, '\\d+') || ''' ' || regexp_replace(line, '^[^ ]* ', '') AS line FROM lines WHERE seq % 6 <> 0""")
def commentary_lines(spark, sf):
    lines = fixtures.commentary_lines(landed.commentary(spark, sf))
    return lines.withColumn("seq", place_number("seq"))


# Pages carry no minute stamps of their own: each element's position stands in for one.
@query("page_lines")
def page_lines(spark, sf):
    stamped = w.table(spark, sf, "pages").select(
        "url", "page_id",
        F.regexp_replace("html", r"(<(?:p|li)\b[^>]*>)", F.concat(F.lit("$1"), F.pmod("page_id", F.lit(95)).cast("string"), F.lit("' "))).alias("html"),
    )
    return fixtures.page_lines(stamped, key="page_id").select("page_id", "seq", F.length("line").alias("chars"))


@query("team_stats", "SELECT fixture_id, CAST(team_order AS INTEGER) AS team_order, team, stat, value FROM tstats")
def team_stats(spark, sf):
    return detail.team_stats(landed.box_scores(spark, sf))


@query("player_stats", """SELECT fixture_id, team, name, position, starter, shots AS "totalShots", saves, faced AS "shotsFaced",
    conceded AS "goalsConceded", CAST(0 AS DOUBLE) AS "redCards" FROM players""")
def player_stats(spark, sf):
    return detail.player_stats(landed.rosters(spark, sf)).select(
        "fixture_id", "team", "name", "position", "starter", "totalShots", "saves", "shotsFaced", "goalsConceded", "redCards"
    )


@query("leaders", "SELECT fixture_id, team, category, leader FROM tops")
def leaders(spark, sf):
    return detail.leaders(landed.leaders(spark, sf))


@query("key_events", "SELECT fixture_id, event_order * 1000000 AS event_order, minute, type, team, text FROM kev")
def key_events(spark, sf):
    events = detail.key_events(landed.key_events(spark, sf))
    return events.withColumn("event_order", place_number("event_order"))


@query("odds_flat", f"SELECT event_id, pos AS position, outcome, {q6('price')} FROM prices")
def odds_flat(spark, sf):
    flat = detail.odds(landed.odds(spark, sf))
    return rounded(flat, "price").select(
        "event_id", F.col("feed_order.payload_order").alias("position"), "outcome", "price"
    )


@query("momentum", """SELECT fixture_id, CAST(round_even(m, 0) AS BIGINT) AS minute, round(value / 100.0 + 1e-9, 6) + 0.0 AS momentum
    FROM (SELECT fixture_id, (epoch_us(ts) // 30000000) / 2.0 - slot * 120 AS m, value FROM ev)""")
def momentum(spark, sf):
    half_minutes = F.floor(F.unix_micros("created_utc") / 30_000_000) / F.lit(2.0) - F.col("slot") * 120
    raw = w.events(spark, sf).select("fixture_id", half_minutes.alias("minute"), "value")
    return rounded(fixtures.momentum(raw), "momentum")


@query("archive_scan", """SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type = 'error' GROUP BY 1""")
def archive_scan(spark, sf):
    """Scan with a declared schema: the filter and three columns reach the Parquet reader."""
    df = tables.scan(spark, f"{sf}/events.parquet", "event_id BIGINT, event_type STRING, value DOUBLE, missing STRING")
    return df.filter(F.col("event_type") == "error").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query("json_rows", """SELECT '{"event_id":' || CAST(event_id AS VARCHAR) || ',"at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S')
    || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '","note":'
    || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '"' || event_type || '"' END || ',"value":null}' AS row FROM events""")
def json_rows(spark, sf):
    df = w.events(spark, sf).select(
        "event_id", F.col("created_utc").alias("at"),
        F.when(F.pmod("event_id", F.lit(3)) != 0, F.col("event_type")).alias("note"),
        F.lit(float("nan")).alias("value"),
    )
    return tables.json_rows(df)


@query("labelled_rows", """SELECT doc_id, lang, text, CASE quality WHEN 0 THEN 'low' WHEN 1 THEN 'good' END AS y
    FROM documents JOIN labels USING (doc_id)""")
def labelled_rows(spark, sf):
    """The labelled texts as training reads them: whole, every language, one scan of each table."""
    texts = w.table(spark, sf, "documents").select("doc_id", "lang", "text")
    rows = w.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")).join(texts, "doc_id")
    return tables.labelled_text([(rows, None)], {0: "low", 1: "good"}).drop("label")


@query("labelled_text", """SELECT doc_id, lang, CASE quality WHEN 0 THEN 'low' WHEN 1 THEN 'good' END AS y
    FROM documents JOIN labels USING (doc_id)""")
def labelled_text(spark, sf):
    joined = w.table(spark, sf, "labels").join(w.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    rows = joined.select("doc_id", "lang", F.col("quality").alias("label"))
    langs = ["de", "en", "es", "fr"]
    parts = [(rows.filter(F.col("lang") == lang).drop("lang"), lang) for lang in langs]
    other = rows.filter(~F.coalesce(F.col("lang").isin(langs), F.lit(False))).select("doc_id", "label", "lang")
    return tables.labelled_text([*parts, (other, None)], {0: "low", 1: "good"}).select("doc_id", "lang", "y")
