"""Fixed schemas of the tables, as DDL."""

import re

EMOTIONS = ("panic", "anger", "joy", "confidence", "despair", "surprise")
EMOTION_COLUMNS = [f"emo_{name}" for name in EMOTIONS]


def column_names(ddl: str) -> list[str]:
    """Names of a flat DDL, usable before a session exists."""
    flat = re.sub(r"<[^>]*>", "", ddl)
    return [part.split()[0] for part in flat.split(", ")]


RAW_REACTION = "fixture_id STRING, created_utc TIMESTAMP, message STRING, source STRING, author STRING"

STATE_COLUMNS = [
    "fixture_id", "minute", "crowd_panic_score", *EMOTION_COLUMNS, "comment_volume",
    "dominant_emotion", "emotional_volatility", "rolling_xg", "delta_xg_10min",
    "arbitrage_index", "flagged", "situation", "situation_confidence",
]

ARCHIVE = (
    "match_id STRING, minute INT, crowd_panic_score DOUBLE, emo_panic DOUBLE, emo_anger DOUBLE, "
    "emo_joy DOUBLE, emo_confidence DOUBLE, emo_despair DOUBLE, emo_surprise DOUBLE, "
    "dominant_emotion STRING, emotional_volatility DOUBLE, comment_volume INT, rolling_xg DOUBLE, "
    "delta_xg_10min DOUBLE, arbitrage_index DOUBLE, flagged BOOLEAN, situation STRING, "
    "situation_confidence DOUBLE, archived_at TIMESTAMP"
)

RESULTS = (
    "match_id STRING, home_team STRING, away_team STRING, kickoff_utc TIMESTAMP, "
    "final_score STRING, state STRING, archived_at TIMESTAMP"
)

PRIORS = (
    "team STRING, matches_played BIGINT, goals_for_per_match DOUBLE, goals_against_per_match DOUBLE, "
    "xg_for_per_match DOUBLE, possession_pct DOUBLE, updated_at TIMESTAMP"
)

STORED_REACTIONS = (
    "match_id STRING, message_hash STRING, minute BIGINT, message STRING, source STRING, "
    "team STRING, author STRING"
)

RUN_STATUS = (
    "match_id STRING, last_run_utc STRING, source STRING, live BOOLEAN, n_reactions BIGINT, "
    "n_commentary BIGINT, reactions_by_source MAP<STRING, BIGINT>, fetch_ok BOOLEAN"
)

FIT_HISTORY = (
    "timestamp TIMESTAMP, log_loss DOUBLE, threshold DOUBLE, evaluated_minutes BIGINT, "
    "matches BIGINT, source STRING"
)

# --- landed JSON payloads ------------------------------------------------------

POST_PAGE = (
    "posts ARRAY<STRUCT<uri: STRING, record: STRUCT<createdAt: STRING, text: STRING>, "
    "author: STRUCT<handle: STRING>>>"
)
TAG_TIMELINE = (
    "ARRAY<STRUCT<id: STRING, created_at: STRING, content: STRING, account: STRUCT<acct: STRING>>>"
)
THREAD_SEARCH = "data STRUCT<children: ARRAY<STRUCT<data: STRUCT<id: STRING, title: STRING>>>>"
THREAD_COMMENTS = (
    "ARRAY<STRUCT<data: STRUCT<children: ARRAY<STRUCT<kind: STRING, "
    "data: STRUCT<created_utc: DOUBLE, body: STRING, author: STRING>>>>>>"
)
LIVE_CHAT = (
    "items ARRAY<STRUCT<snippet: STRUCT<publishedAt: STRING, displayMessage: STRING>, "
    "authorDetails: STRUCT<displayName: STRING>>>"
)
SEARCH_ANSWER = (
    "output_text STRING, output ARRAY<STRUCT<type: STRING, content: ARRAY<STRUCT<text: STRING>>>>"
)
SEARCH_POSTS = "ARRAY<STRUCT<text: STRING, created_at: STRING, handle: STRING, author: STRING>>"

SCOREBOARD = (
    "events ARRAY<STRUCT<id: STRING, name: STRING, shortName: STRING, date: STRING, "
    "status: STRUCT<displayClock: STRING, type: STRUCT<state: STRING>>, "
    "competitions: ARRAY<STRUCT<status: STRUCT<displayClock: STRING, type: STRUCT<state: STRING>>, "
    "competitors: ARRAY<STRUCT<homeAway: STRING, score: STRING, team: STRUCT<displayName: STRING>>>>>>>"
)
COMMENTARY = "commentary ARRAY<STRUCT<text: STRING, time: STRUCT<displayValue: STRING>>>"
BOXSCORE = (
    "boxscore STRUCT<teams: ARRAY<STRUCT<team: STRUCT<displayName: STRING>, "
    "statistics: ARRAY<STRUCT<name: STRING, displayValue: STRING>>>>>"
)
ROSTERS = (
    "rosters ARRAY<STRUCT<team: STRUCT<displayName: STRING>, roster: ARRAY<STRUCT<"
    "athlete: STRUCT<displayName: STRING>, position: STRUCT<abbreviation: STRING>, starter: BOOLEAN, "
    "stats: ARRAY<STRUCT<name: STRING, value: DOUBLE>>>>>>"
)
LEADERS = (
    "leaders ARRAY<STRUCT<team: STRUCT<displayName: STRING>, leaders: ARRAY<STRUCT<name: STRING, "
    "leaders: ARRAY<STRUCT<athlete: STRUCT<displayName: STRING>, displayValue: STRING>>>>>>"
)
KEY_EVENTS = (
    "keyEvents ARRAY<STRUCT<type: STRUCT<type: STRING>, clock: STRUCT<value: DOUBLE>, "
    "team: STRUCT<displayName: STRING>, text: STRING>>"
)
MATCH_DETAIL = ", ".join([BOXSCORE, ROSTERS, LEADERS, KEY_EVENTS])
ODDS_EVENT = (
    "home_team STRING, away_team STRING, bookmakers ARRAY<STRUCT<markets: ARRAY<STRUCT<key: STRING, "
    "outcomes: ARRAY<STRUCT<name: STRING, price: DOUBLE>>>>>>"
)
