"""Play-by-play lines to typed events and a rolling threat series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.text import BLANK, strip
from terrace.operators.minutes import last_rows, possible, zero_filled

THREAT_WINDOW = 10

# Ordered patterns, the first that matches names the event.
EVENT_PATTERNS: list[tuple[str, str, float]] = [
    (r"\bgoal\b|\bscores\b", "goal", 0.40),
    (r"\bpenalty\b", "penalty", 0.76),
    (r"\bbig chance\b|\bsitter\b|\bone on one\b", "big_chance", 0.35),
    (r"\bhits the (post|crossbar|bar)\b|\bwoodwork\b", "woodwork", 0.30),
    (r"\bshot on target\b|\bforces a save\b|\bsaved\b|\bgreat save\b", "shot_on_target", 0.30),
    (r"\bshot (off target|wide)\b|\bgoes wide\b|\bover the bar\b|\bblazes\b", "shot_off_target", 0.07),
    (r"\bblocked\b", "blocked_shot", 0.05),
    (r"\bdangerous free[- ]kick\b", "free_kick", 0.08),
    (r"\bcorner\b", "corner", 0.03),
]

# Minute stamp (stoppage part ignored), optional team, body.
LINE = rf"(?d)^[{BLANK}]*(\p{{Nd}}+)(?:\+\p{{Nd}}+)?'[{BLANK}]*(?:([A-Za-z .'-]+?)[{BLANK}]*:)?[{BLANK}]*(.+)$"


def _first_match(body: Column, values: list[Column], otherwise: Column) -> Column:
    chain = None
    for (pattern, _, _), value in zip(EVENT_PATTERNS, values):
        test = body.rlike("(?U)" + pattern)
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain.otherwise(otherwise)


def _minute(line: Column) -> Column:
    return F.regexp_extract(line, LINE, 1).try_cast("bigint")


def parse_commentary(lines: DataFrame) -> DataFrame:
    """``line`` to (minute, team, event_type, xg_value); non-lines and lines with an impossible minute are dropped.

    ``quarantined_lines`` gives the latter.
    """
    line = F.coalesce(F.col("line"), F.lit(""))
    team = F.regexp_extract(line, LINE, 2)
    parts = lines.filter(line.rlike(LINE) & possible(_minute(line))).select(
        *[c for c in lines.columns if c != "line"],
        _minute(line).alias("minute"),
        F.when(team == "", F.lit("unknown")).otherwise(strip(team)).alias("team"),
        F.lower(F.regexp_extract(line, LINE, 3)).alias("_body"),
    )
    kinds = [F.lit(i) for i in range(len(EVENT_PATTERNS))]
    typed = parts.withColumn("_kind", _first_match(F.col("_body"), kinds, F.lit(-1)))
    names = F.array(*[F.lit(name) for _, name, _ in EVENT_PATTERNS])
    worth = F.array(*[F.lit(xg) for _, _, xg in EVENT_PATTERNS])
    return typed.select(
        *[c for c in parts.columns if c != "_body"],
        F.coalesce(F.get(names, F.col("_kind")), F.lit("play")).alias("event_type"),
        F.coalesce(F.get(worth, F.col("_kind")), F.lit(0.0)).alias("xg_value"),
    )


def quarantined_lines(lines: DataFrame) -> DataFrame:
    """Lines that look like play-by-play but whose minute no match can have, with a ``reason``.

    A stamp too long for a number counts as impossible too. Texts that are no
    play-by-play line at all belong to neither side.
    """
    line = F.coalesce(F.col("line"), F.lit(""))
    return lines.filter(line.rlike(LINE) & ~possible(_minute(line))).withColumn("reason", F.lit("impossible minute"))


def minute_xg(events: DataFrame) -> DataFrame:
    """Summed xG per minute, minutes without events at 0."""
    per_minute = events.groupBy("fixture_id", "minute").agg(F.sum("xg_value").alias("xg_value"))
    return zero_filled(per_minute, ["xg_value"])


def rolling_threat(events: DataFrame, window: int = THREAT_WINDOW) -> DataFrame:
    """Rolling xG over the last ``window`` minutes and its tanh."""
    rolling = F.sum("xg_value").over(last_rows(window))
    return minute_xg(events).select(
        "fixture_id", "minute", rolling.alias("rolling_xg"), F.tanh(rolling).alias("delta_xg_10min")
    )


def threat_series(lines: DataFrame, window: int = THREAT_WINDOW) -> DataFrame:
    return rolling_threat(parse_commentary(lines), window)
