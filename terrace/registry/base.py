"""Registration of named queries and the shared views of their check SQL.

The SQL below restates each view over the raw tables in the check engine's own
dialect; it shares only parameters (word lists, constants) with the library.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace import workload as w
from terrace.operators.situation import PROTOTYPES, WEIGHTS
from terrace.operators.threat import EVENT_PATTERNS
from terrace.schemas import EMOTION_COLUMNS, EMOTIONS
from terrace.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
THRESHOLD = 0.5
AS_OF = "2024-01-31 00:30:00"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say the same, its check."""
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_views(sql)
        return fn

    return register


def r6(col: str | Column) -> Column:
    """Six digits, never negative zero, so that two engines hash alike.

    The offset keeps exact ties (0.0640625) from rounding by summation noise.
    """
    out = F.round((F.col(col) if isinstance(col, str) else col) + F.lit(1e-9), 6) + F.lit(0.0)
    return out.alias(col) if isinstance(col, str) else out


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in columns})


def place_number(column: str) -> Column:
    """Payload and position of a place as one number, for the check's small payloads."""
    return F.col(f"{column}.payload_order") * 1_000_000 + F.col(f"{column}.position")


def s6(expression: str) -> str:
    """``r6`` in the check dialect."""
    return f"round({expression} + 1e-9, 6) + 0.0"


def q6(*columns: str) -> str:
    return ", ".join(f"{s6(c)} AS {c}" for c in columns)


def exact4(x: str) -> str:
    """Exact four-digit rounding of a double column, by error-free multiplication."""
    head = f"({x} * 134217729e0 - ({x} * 134217729e0 - {x}))"
    error = f"(({head} * 1e4 - {x} * 1e4) + ({x} - {head}) * 1e4)"
    off_tie = f"(({x} * 1e4 - floor({x} * 1e4) - 0.5e0) + {error})"
    return (
        f"(floor({x} * 1e4) + CASE WHEN {off_tie} > 0 THEN 1 WHEN {off_tie} < 0 THEN 0 "
        f"ELSE floor({x} * 1e4) % 2 END) / 1e4"
    )


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def term_sum(text: str, terms: dict[str, float]) -> str:
    """Weighted literal counts by length difference."""
    parts = [
        f"((length({text}) - length(replace({text}, {literal(t)}, ''))) / {len(t)}) * CAST({x} AS DOUBLE)"
        for t, x in terms.items()
    ]
    return " + ".join(parts)


EMO = ", ".join(EMOTION_COLUMNS)
EMO_SUM = " + ".join(EMOTION_COLUMNS)
BALANCE = "1.2*emo_panic + 1.1*emo_despair + 0.6*emo_anger - (emo_confidence + 0.9*emo_joy)"
PER_FIXTURE = "PARTITION BY fixture_id ORDER BY minute"

WORDS = r"[\p{L}\p{N}_]"
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
NOT_WS = r"[^\s\x1c-\x1f\x85\p{Z}]"
URL = f"https?://{NOT_WS}+"
MENTION = f"[@#]{WORDS}+"


def dominant_sql(columns: list[str] | tuple[str, ...] = tuple(EMOTION_COLUMNS)) -> str:
    top = f"greatest({', '.join(columns)})"
    whens = " ".join(f"WHEN {c} = {top} THEN '{e}'" for c, e in zip(columns, EMOTIONS))
    return f"CASE WHEN {top} <= 0 THEN 'neutral' {whens} END"


def event_case(what: int) -> str:
    whens = " ".join(
        f"WHEN regexp_matches(body, {literal(p)}) THEN " + (literal(n) if what == 1 else f"CAST({x} AS DOUBLE)")
        for p, n, x in EVENT_PATTERNS
    )
    return f"CASE {whens} ELSE {literal('play') if what == 1 else 'CAST(0 AS DOUBLE)'} END"


def ffill(col: str, default: str) -> str:
    return (
        f"coalesce(last_value({col} IGNORE NULLS) OVER ({PER_FIXTURE} ROWS BETWEEN UNBOUNDED PRECEDING "
        f"AND CURRENT ROW), {default})"
    )


def distances_sql() -> str:
    items = []
    for centre in PROTOTYPES.values():
        items.append(" + ".join(f"pow((f{i} - ({c})) * {x}, 2)" for i, (c, x) in enumerate(zip(centre, WEIGHTS))))
    return "[" + ", ".join(items) + "]"


LINE_SQL = r"^\s*(\d+)(?:\+\d+)?'\s*(?:([A-Za-z .'-]+?)\s*:)?\s*(.+)$"

# Views in dependency order: name -> body.
VIEWS: dict[str, str] = {
    "ev": """SELECT *, epoch_us(ts) // 7200000000 AS slot,
        'ESPN-' || CAST(epoch_us(ts) // 7200000000 AS VARCHAR) AS fixture_id FROM events""",
    "fx": f"""SELECT 'ESPN-' || CAST(slot AS VARCHAR) AS fixture_id, slot,
        make_timestamp((slot * 7200 + 1200) * 1000000) AS kickoff_utc,
        ({w.TEAMS})[slot % 8 + 1] AS home_team,
        ({w.TEAMS})[(slot % 8 + (slot // 8) % 7 + 1) % 8 + 1] AS away_team,
        CAST(slot % 4 AS VARCHAR) || '-' || CAST((slot // 3) % 3 AS VARCHAR) AS score,
        (['pre', 'in', 'post'])[slot % 3 + 1] AS state
        FROM (SELECT DISTINCT slot FROM ev)""",
    "posts": """SELECT fixture_id, ts AS created_utc, event_type AS source, 'u' || CAST(user_id AS VARCHAR) AS author,
        event_id AS ingest_seq, event_id % (SELECT count(*) FROM documents) AS doc_id
        FROM ev WHERE event_type IN ('click', 'view', 'signup')""",
    "reactions": "SELECT p.*, d.text AS message FROM posts p JOIN documents d USING (doc_id)",
    "timed": """SELECT p.*, CAST(least(greatest((epoch_us(created_utc) - epoch_us(kickoff_utc)) // 60000000, 0), 130) AS BIGINT)
        AS minute FROM posts p JOIN fx USING (fixture_id) WHERE created_utc >= kickoff_utc - INTERVAL 15 MINUTE""",
    "emo": "SELECT doc_id, " + ", ".join(
        f"{term_sum('low', w.LEXICON[e])} AS emo_{e}" for e in EMOTIONS
    ) + " FROM (SELECT doc_id, lower(text) AS low FROM documents)",
    "shares": "SELECT doc_id, " + ", ".join(
        f"CASE WHEN {EMO_SUM} > 0 THEN {c} / ({EMO_SUM}) ELSE 0 END AS {c}" for c in EMOTION_COLUMNS
    ) + " FROM emo",
    "shared": f"SELECT t.*, {EMO} FROM timed t JOIN shares USING (doc_id)",
    "means": "SELECT fixture_id, minute, " + ", ".join(f"avg({c}) AS {c}" for c in EMOTION_COLUMNS)
        + ", count(*) AS comment_volume FROM shared GROUP BY ALL",
    "cal": """SELECT fixture_id, unnest(range(0, max(minute) + 1)) AS minute FROM means GROUP BY fixture_id""",
    "prof": "SELECT fixture_id, minute, " + ", ".join(f"{ffill(c, '0')} AS {c}" for c in EMOTION_COLUMNS)
        + f", {ffill('comment_volume', '0')} AS comment_volume FROM cal LEFT JOIN means USING (fixture_id, minute)",
    "series0": f"""SELECT *, tanh(2 * ({BALANCE})) AS p, coalesce(("""
        + " + ".join(f"abs({c} - lag({c}) OVER ({PER_FIXTURE}))" for c in EMOTION_COLUMNS) + ") / 2, 0) AS step FROM prof",
    "series": f"""SELECT fixture_id, minute, avg(p) OVER ({PER_FIXTURE} ROWS 4 PRECEDING) AS crowd_panic_score, {EMO},
        comment_volume, {dominant_sql()} AS dominant_emotion,
        avg(step) OVER ({PER_FIXTURE} ROWS 4 PRECEDING) AS emotional_volatility FROM series0""",
    "lines": f"""SELECT fixture_id, event_id AS seq,
        CASE WHEN m > 90 THEN '90+' || CAST(m - 90 AS VARCHAR) ELSE CAST(m AS VARCHAR) END || ''' '
        || CASE WHEN event_id % 2 = 1 THEN home_team ELSE away_team END || ': ' || ({w.PHRASES})[event_id % 10 + 1] AS line
        FROM (SELECT ev.*, home_team, away_team, greatest((epoch_us(ts) - epoch_us(kickoff_utc)) // 60000000, 0) AS m
              FROM ev JOIN fx USING (fixture_id) WHERE event_type IN ('purchase', 'error'))""",
    "parsed": f"""SELECT fixture_id, seq, CAST(regexp_extract(line, {literal(LINE_SQL)}, 1) AS BIGINT) AS minute,
        coalesce(nullif(trim(regexp_extract(line, {literal(LINE_SQL)}, 2)), ''), 'unknown') AS team,
        lower(regexp_extract(line, {literal(LINE_SQL)}, 3)) AS body
        FROM lines WHERE regexp_matches(line, {literal(LINE_SQL)})""",
    "mev": f"SELECT fixture_id, seq, minute, team, {event_case(1)} AS event_type, {event_case(2)} AS xg_value FROM parsed",
    "mxg": """SELECT fixture_id, minute, coalesce(x, 0) AS xg_value
        FROM (SELECT fixture_id, unnest(range(0, max(minute) + 1)) AS minute FROM mev GROUP BY 1)
        LEFT JOIN (SELECT fixture_id, minute, sum(xg_value) AS x FROM mev GROUP BY ALL) USING (fixture_id, minute)""",
    "threat": f"""SELECT fixture_id, minute, r AS rolling_xg, tanh(r) AS delta_xg_10min FROM (
        SELECT *, sum(xg_value) OVER ({PER_FIXTURE} ROWS 9 PRECEDING) AS r FROM mxg)""",
    "joined": "SELECT * FROM series FULL JOIN threat USING (fixture_id, minute)",
    "filled": "SELECT fixture_id, minute, "
        + ", ".join(f"{ffill(c, '0')} AS {c}" for c in [
            "crowd_panic_score", "rolling_xg", "delta_xg_10min", *EMOTION_COLUMNS, "emotional_volatility", "comment_volume"])
        + f", {ffill('dominant_emotion', literal('neutral'))} AS dominant_emotion FROM joined",
    "st0": """SELECT *, abs(least(greatest(crowd_panic_score, -1), 1)) * (1 - least(greatest(delta_xg_10min, 0), 1))
        AS arbitrage_index FROM filled""",
    "st": f"SELECT *, arbitrage_index >= {THRESHOLD} AS flagged FROM st0",
    "feat": """SELECT *, least(greatest(crowd_panic_score, -1), 1) AS f0, least(greatest(delta_xg_10min, 0), 1) AS f1,
        least(greatest(emotional_volatility, 0), 1) AS f2, least(greatest(arbitrage_index, 0), 1) AS f3,
        least(minute / 95.0, 1.4) AS f4 FROM st""",
    "dist": f"SELECT *, {distances_sql()} AS d FROM feat",
    "cls": f"""SELECT * EXCLUDE (f0, f1, f2, f3, f4, d),
        ({list(PROTOTYPES)})[list_position(d, list_min(d))] AS situation,
        round_even(1 / list_sum(list_transform(d, lambda x: exp(-(x - list_min(d)) / 0.25))), 4) AS situation_confidence
        FROM dist""",
    "fl": "SELECT fixture_id, minute FROM st WHERE flagged",
    "alert_steps": """SELECT fixture_id, min(minute) AS m FROM fl GROUP BY 1 UNION ALL
        SELECT fixture_id, (SELECT min(minute) FROM fl WHERE fl.fixture_id = a.fixture_id AND fl.minute >= a.m + 15) FROM alert_steps a WHERE a.m IS NOT NULL""",
    "latest": "SELECT * FROM cls QUALIFY row_number() OVER (PARTITION BY fixture_id ORDER BY minute DESC) = 1",
}


def with_views(sql: str) -> str:
    """Prefix the views a statement needs, directly or through other views."""
    needed: set[str] = set()
    pending = [sql]
    while pending:
        words = set(re.findall(r"\b[a-z_0-9]+\b", pending.pop()))
        for name in words & VIEWS.keys() - needed:
            needed.add(name)
            pending.append(VIEWS[name])
    if not needed:
        return sql
    ordered = [n for n in VIEWS if n in needed]
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in ordered)
    return f"WITH RECURSIVE {views}\n{sql}"


# --- shared Spark views --------------------------------------------------------

def mood_series(spark: SparkSession, sf: str) -> DataFrame:
    from terrace.operators import mood

    return mood.series_from_profile(mood.dense_profile(mood.minute_means(w.shared_chat(spark, sf))))


def state(spark: SparkSession, sf: str) -> DataFrame:
    from terrace.operators import selector, threat

    social = mood_series(spark, sf)
    match = threat.threat_series(w.commentary(spark, sf))
    return selector.fill_mood(selector.select_moments(social, match, THRESHOLD))


def classified(spark: SparkSession, sf: str) -> DataFrame:
    from terrace.operators.situation import classify

    return classify(state(spark, sf))
