"""Landed scoreboards, commentary, pages and momentum."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace import schemas
from terrace.functions.text import leading_digits, parse_utc, strip

STAMP = re.compile(r"\d+(?:\+\d+)?'")
# Elements without content, and those whose text is not shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(["script", "style", "template"])


def scoreboard(landed: DataFrame) -> DataFrame:
    """One row per fixture of each landed board (payload_order, payload)."""
    events = landed.select(
        "payload_order", F.posexplode(F.from_json("payload", schemas.SCOREBOARD)["events"]).alias("_pos", "e")
    )
    first = F.get("e.competitions", F.lit(0))
    status = F.coalesce(first["status"], F.col("e.status"))

    def side(name: str) -> Column:
        return F.get(F.filter(first["competitors"], lambda c: c["homeAway"] == name), F.lit(0))

    def text(col: Column, default: str = "") -> Column:
        return F.coalesce(col, F.lit(default))

    home, away = side("home"), side("away")
    return events.select(
        text(F.col("e.id")).alias("event_id"), text(F.col("e.name")).alias("name"),
        text(F.col("e.shortName")).alias("short_name"), parse_utc(F.col("e.date")).alias("kickoff_utc"),
        text(status["type"]["state"]).alias("state"),
        F.coalesce(leading_digits(text(status["displayClock"])), F.lit(0)).alias("clock_minute"),
        text(home["team"]["displayName"]).alias("home_team"), text(away["team"]["displayName"]).alias("away_team"),
        F.concat(text(home["score"], "0"), F.lit("-"), text(away["score"], "0")).alias("score"),
        F.struct(F.col("payload_order").cast("bigint").alias("payload_order"), F.col("_pos").alias("position")).alias("feed_order"),
    )


def commentary_lines(landed: DataFrame) -> DataFrame:
    """``fixture_id, seq, line``, oldest first: the feed is newest first, so ``seq`` negates (payload, position)."""
    rows = landed.select(
        "fixture_id", "payload_order",
        F.posexplode(F.from_json("payload", schemas.COMMENTARY)["commentary"]).alias("_pos", "c"),
    )
    minute = F.regexp_extract(F.coalesce("c.time.displayValue", F.lit("")), r"(\p{Nd}+)", 1)
    text = strip(F.coalesce("c.text", F.lit("")))
    return rows.filter((text != "") & (minute != "")).select(
        "fixture_id",
        F.struct((-F.col("payload_order").cast("bigint")).alias("payload_order"), (-F.col("_pos")).alias("position")).alias("seq"),
        F.concat(minute, F.lit("' "), text).alias("line"),
    )


class _Stamped(HTMLParser):
    """Text of the ``p`` and ``li`` elements that starts with a minute stamp.

    An element ends at its own end tag or at that of one around it, so a ``p``
    in an ``li`` gives two lines. Texts are kept once and elements as ranges of
    them, so deep nesting costs nothing where no line is stamped.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int | None]] = []
        self.texts: list[str] = []
        self.ranges: list[list[int | None]] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            return
        mark = None
        if tag in ("p", "li"):
            mark = len(self.ranges)
            self.ranges.append([len(self.texts), None])
        self.silent += tag in SILENT
        self.open.append((tag, mark))

    def handle_endtag(self, tag: str) -> None:
        if not any(name == tag for name, _ in reversed(self.open)):
            return
        name = None
        while name != tag:
            name, mark = self.open.pop()
            self.silent -= name in SILENT
            if mark is not None:
                self.ranges[mark][1] = len(self.texts)

    def handle_data(self, data: str) -> None:
        text = data.strip()
        if text and not self.silent:
            self.texts.append(text)

    def lines(self) -> list[dict]:
        bounds = [(i, start, len(self.texts) if end is None else end) for i, (start, end) in enumerate(self.ranges)]
        return [
            {"seq": i, "line": " ".join(self.texts[start:end])}
            for i, start, end in bounds if start < end and STAMP.match(self.texts[start])
        ]


def _stamped(html: str | None) -> list[dict]:
    parser = _Stamped()
    parser.feed(html or "")
    parser.close()
    return parser.lines()


def stamped_lines(html: Column) -> Column:
    """Array of (seq, line), one page after another in Arrow batches."""
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(_stamped)

    return F.pandas_udf(read, "array<struct<seq: int, line: string>>")(html)


def page_lines(pages: DataFrame, html: str = "html", key: str = "url") -> DataFrame:
    """Minute-stamped lines out of the ``p`` and ``li`` elements of raw pages.

    Comments, scripts, styles and templates are dropped, character references
    decoded; the stripped texts inside an element are joined by a blank. ``seq``
    is the element's place among all ``p`` and ``li`` of its page. Null or empty
    pages have no line.
    """
    return pages.select(key, F.inline(stamped_lines(F.col(html))))


def momentum(raw: DataFrame) -> DataFrame:
    """Attack momentum: whole minutes (half to even), value in -1..1."""
    return raw.select(
        "fixture_id", F.rint(F.col("minute").cast("double")).cast("bigint").alias("minute"),
        (F.col("value").cast("double") / 100.0).alias("momentum"),
    )
