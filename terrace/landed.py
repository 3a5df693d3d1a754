"""Landed JSON payloads written from the benchmark tables, one small payload per row.

Every builder is a projection (or a two-sided aggregate) followed by ``to_json``,
so landing grows with the tables and never gathers a fixture in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace import workload as w
from terrace.session import fan_out


def _payload(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields)).alias("payload")


def _texts(spark: SparkSession, sf: str, kinds: list[str]) -> DataFrame:
    """Events of some kinds with a document's whole text."""
    documents = w.table(spark, sf, "documents")
    n = documents.agg(F.count(F.lit(1))).scalar()
    rows = w.events(spark, sf).filter(F.col("event_type").isin(*kinds)).withColumn("doc_id", F.pmod("event_id", n))
    return rows.join(fan_out(documents.select("doc_id", "text")), "doc_id").withColumns({
        "author": F.concat(F.lit("u"), F.col("user_id").cast("string")),
        "iso": stamp(),
    })


def stamp() -> Column:
    """ISO time: microseconds, milliseconds, whole minutes, or not a time at all."""
    at = F.col("created_utc")
    return (
        F.when(F.pmod("event_id", F.lit(7)) == 0, "not a timestamp")
        .when(F.pmod("event_id", F.lit(3)) == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .when(F.pmod("event_id", F.lit(3)) == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm'Z'"))
        .otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))
    )


def _third() -> Column:
    return F.floor(F.col("event_id") / 3).cast("string")


def post_pages(spark, sf):
    item = F.struct(
        F.concat(F.lit("at://"), _third()).alias("uri"),
        F.struct(F.col("iso").alias("createdAt"), F.col("text")).alias("record"),
        F.struct(F.col("author").alias("handle")).alias("author"),
    )
    return _texts(spark, sf, ["click"]).select(
        "fixture_id", F.col("event_id").alias("payload_order"), _payload(F.array(item).alias("posts"))
    )


def tag_timelines(spark, sf):
    item = F.struct(
        _third().alias("id"), F.col("iso").alias("created_at"),
        F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("content"),
        F.struct(F.col("author").alias("acct")).alias("account"),
    )
    return _texts(spark, sf, ["view"]).select(
        "fixture_id", F.col("event_id").alias("payload_order"), F.to_json(F.array(item)).alias("payload")
    )


def thread_searches(spark, sf):
    """One search page per fixture: a preview thread, then two match threads."""
    def child(suffix: str, title: str) -> Column:
        return F.struct(F.struct(F.concat("fixture_id", F.lit(suffix)).alias("id"), F.lit(title).alias("title")).alias("data"))

    children = F.array(child("-p", "Preview"), child("-a", "Match Thread: live"), child("-b", "match thread (second)"))
    return w.fixtures(spark, sf).select(
        "fixture_id", F.lit(0).alias("payload_order"), _payload(F.struct(children.alias("children")).alias("data"))
    )


def thread_comments(spark, sf):
    kind = F.when(F.pmod("event_id", F.lit(5)) == 0, "more").otherwise("t1")
    child = F.struct(kind.alias("kind"), F.struct(
        F.unix_seconds("created_utc").cast("double").alias("created_utc"), F.col("text").alias("body"), F.col("author")
    ).alias("data"))
    listing = F.struct(F.struct(F.array(child).alias("children")).alias("data"))
    post = F.struct(F.struct(F.array().cast("array<struct<kind:string,data:struct<created_utc:double,body:string,author:string>>>").alias("children")).alias("data"))
    suffix = F.when(F.pmod("event_id", F.lit(2)) == 0, "-a").otherwise("-b")
    return _texts(spark, sf, ["purchase"]).select(
        "fixture_id", F.concat("fixture_id", suffix).alias("thread_id"), F.col("event_id").alias("payload_order"),
        F.to_json(F.array(post, listing)).alias("payload"),
    )


def live_chat(spark, sf):
    item = F.struct(
        F.struct(F.col("iso").alias("publishedAt"), F.col("text").alias("displayMessage")).alias("snippet"),
        F.struct(F.col("author").alias("displayName")).alias("authorDetails"),
    )
    return _texts(spark, sf, ["signup"]).select(
        "fixture_id", F.col("event_id").alias("payload_order"), _payload(F.array(item).alias("items"))
    )


def search_answers(spark, sf):
    """Prose around a JSON array; every fourth answer rambles without one."""
    post = F.struct(
        F.col("text"), F.when(F.pmod("event_id", F.lit(7)) != 0, F.col("iso")).alias("created_at"),
        F.when(F.pmod("event_id", F.lit(2)) == 0, F.col("author")).alias("handle"), F.col("author"),
    )
    said = F.when(F.pmod("event_id", F.lit(4)) == 0, F.lit("nothing to list")).otherwise(
        F.concat(F.lit("Here are the posts:\n"), F.to_json(F.array(post)))
    )
    output = F.array(F.struct(F.lit("message").alias("type"), F.array(F.struct(said.alias("text"))).alias("content")))
    return _texts(spark, sf, ["error"]).select(
        "fixture_id", F.col("event_id").alias("payload_order"),
        _payload(F.when(F.pmod("event_id", F.lit(3)) == 0, said).alias("output_text"), output.alias("output")),
    )


def scoreboards(spark, sf):
    f = w.fixtures(spark, sf)
    status = F.struct(
        F.concat(F.pmod("slot", F.lit(97)).cast("string"), F.lit("'+2'")).alias("displayClock"),
        F.struct(F.col("state")).alias("type"),
    )
    def side(name: str, team: str, position: int) -> Column:
        goals = F.get(F.split("score", "-"), F.lit(position))
        return F.struct(F.lit(name).alias("homeAway"), goals.alias("score"), F.struct(F.col(team).alias("displayName")).alias("team"))

    nested = F.pmod("slot", F.lit(2)) == 0
    competition = F.struct(
        F.when(nested, status).alias("status"),
        F.array(side("away", "away_team", 1), side("home", "home_team", 0)).alias("competitors"),
    )
    event = F.struct(
        F.col("slot").cast("string").alias("id"), F.concat("away_team", F.lit(" at "), "home_team").alias("name"),
        F.concat(F.upper("away_team"), F.lit(" @ "), F.upper("home_team")).alias("shortName"),
        F.date_format("kickoff_utc", "yyyy-MM-dd'T'HH:mm'Z'").alias("date"), F.when(~nested, status).alias("status"),
        F.array(competition).alias("competitions"),
    )
    return f.select(F.col("slot").alias("payload_order"), _payload(F.array(event).alias("events")))


def commentary(spark, sf):
    """One entry per line; half-time notes without a clock are mixed in."""
    lines = w.commentary(spark, sf)
    text = F.regexp_replace("line", r"^[^ ]* ", "")
    clock = F.when(F.pmod("seq", F.lit(6)) == 0, "HT").otherwise(F.get(F.split("line", " "), F.lit(0)))
    entry = F.struct(text.alias("text"), F.struct(clock.alias("displayValue")).alias("time"))
    return lines.select("fixture_id", F.col("seq").alias("payload_order"), _payload(F.array(entry).alias("commentary")))


def _sided(spark, sf) -> DataFrame:
    return w.events(spark, sf).withColumn("side", F.when(F.pmod("event_id", F.lit(2)) == 1, 0).otherwise(1))


def _named(spark, sf) -> DataFrame:
    return w.fixtures(spark, sf).select("fixture_id", "home_team", "away_team")


def team_counts(spark, sf) -> DataFrame:
    """Per fixture: counts of each side's events, the source of the statistics."""
    aggregates = []
    for i in (0, 1):
        mine = F.col("side") == i
        def n(test: Column, mine=mine) -> Column:
            return F.sum(F.when(mine & test, 1).otherwise(0))

        kind = F.col("event_type")
        aggregates += [
            n(F.lit(True)).alias(f"n{i}"), n(kind == "purchase").alias(f"shots{i}"),
            n((kind == "purchase") & (F.pmod("event_id", F.lit(5)) < 2)).alias(f"target{i}"),
            n(kind == "error").alias(f"saves{i}"),
        ]
    return _sided(spark, sf).groupBy("fixture_id").agg(*aggregates)


def box_scores(spark, sf):
    rows = team_counts(spark, sf).join(_named(spark, sf), "fixture_id")
    total = F.col("n0") + F.col("n1")

    def team(i: int, name: str) -> Column:
        def stat(label: str, value: Column) -> Column:
            return F.struct(F.lit(label).alias("name"), value.cast("string").alias("displayValue"))

        shown = F.concat(F.floor(100 * F.col(f"n{i}") / total).cast("string"), F.lit("%"))
        return F.struct(F.struct(F.col(name).alias("displayName")).alias("team"), F.array(
            stat("possessionPct", shown), stat("totalShots", F.col(f"shots{i}")), stat("shotsOnTarget", F.col(f"target{i}")),
            stat("saves", F.col(f"saves{i}")), stat("notKept", F.col(f"n{i}")),
        ).alias("statistics"))

    return rows.select("fixture_id", F.lit(0).alias("payload_order"), _payload(
        F.struct(F.array(team(0, "home_team"), team(1, "away_team")).alias("teams")).alias("boxscore")))


def rosters(spark, sf):
    """One payload per player: users are players, every eleventh a goalkeeper."""
    kind = F.col("event_type")
    def n(value: str) -> Column:
        return F.sum(F.when(kind == value, 1.0).otherwise(0.0))

    players = _sided(spark, sf).groupBy("fixture_id", "side", "user_id").agg(
        n("error").alias("saves"), n("purchase").alias("shots"), n("click").alias("faced"), n("view").alias("conceded")
    ).join(_named(spark, sf), "fixture_id")

    def stat(label: str, value: Column) -> Column:
        return F.struct(F.lit(label).alias("name"), value.alias("value"))

    bench = F.pmod("user_id", F.lit(13)) == 0
    stats = F.array(stat("saves", F.col("saves")), stat("totalShots", F.col("shots")),
                    stat("shotsFaced", F.col("faced")), stat("goalsConceded", F.col("conceded")))
    player = F.struct(
        F.struct(F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("displayName")).alias("athlete"),
        F.struct(F.when(F.pmod("user_id", F.lit(11)) == 0, "G").otherwise("F").alias("abbreviation")).alias("position"),
        (F.pmod("user_id", F.lit(2)) == 0).alias("starter"),
        F.when(~bench, stats).otherwise(F.slice(stats, 1, 0)).alias("stats"),
    )

    def team(i: int, name: str) -> Column:
        return F.struct(F.struct(F.col(name).alias("displayName")).alias("team"),
                        F.filter(F.array(player), lambda p: F.col("side") == i).alias("roster"))

    return players.select("fixture_id", F.col("user_id").alias("payload_order"),
                          _payload(F.array(team(0, "home_team"), team(1, "away_team")).alias("rosters")))


def leaders(spark, sf):
    """Per team the user with most events of a kind leads a category."""
    kinds = {"totalShots": "purchase", "saves": "error", "accuratePasses": "click"}
    per_user = _sided(spark, sf).groupBy("fixture_id", "side", "user_id").agg(
        *[F.sum(F.when(F.col("event_type") == k, 1).otherwise(0)).alias(c) for c, k in kinds.items()]
    )
    best = per_user.groupBy("fixture_id", "side").agg(
        *[F.max(F.struct(F.col(c).alias("n"), F.col("user_id").alias("u"))).alias(c) for c in kinds]
    ).join(_named(spark, sf), "fixture_id")
    team = F.when(F.col("side") == 0, F.col("home_team")).otherwise(F.col("away_team"))

    def category(c: str) -> Column:
        top = F.struct(
            F.struct(F.when(F.col(c)["n"] > 0, F.concat(F.lit("P"), F.col(c)["u"].cast("string"))).alias("displayName")).alias("athlete"),
            F.col(c)["n"].cast("string").alias("displayValue"),
        )
        return F.struct(F.lit(c).alias("name"), F.array(top).alias("leaders"))

    block = F.struct(F.struct(team.alias("displayName")).alias("team"), F.array(*[category(c) for c in kinds]).alias("leaders"))
    return best.select("fixture_id", F.col("side").alias("payload_order"), _payload(F.array(block).alias("leaders")))


def key_events(spark, sf):
    rows = w.events(spark, sf).join(w.fixtures(spark, sf).select("fixture_id", "kickoff_utc", "home_team", "away_team"), "fixture_id")
    seconds = F.greatest(F.unix_seconds("created_utc") - F.unix_seconds("kickoff_utc"), F.lit(0)).cast("double")
    kind = F.element_at(
        F.array(*[F.lit(k) for k in ("goal", "yellow-card", "penalty--scored", "", "own-goal", "substitution")]),
        (F.pmod("event_id", F.lit(6)) + 1).cast("int"),
    )
    event = F.struct(
        F.struct(F.when(kind != "", kind).alias("type")).alias("type"), F.struct(seconds.alias("value")).alias("clock"),
        F.struct(F.when(F.pmod("event_id", F.lit(2)) == 1, F.col("home_team")).otherwise(F.col("away_team")).alias("displayName")).alias("team"),
        F.when(F.pmod("event_id", F.lit(4)) == 0, F.concat(F.lit("scored by u"), F.col("user_id").cast("string"))).alias("text"),
    )
    return rows.select("fixture_id", F.col("event_id").alias("payload_order"), _payload(F.array(event).alias("keyEvents")))


def odds(spark, sf):
    """One payload per order line: parts are market events, suppliers bookmakers, return flags outcomes."""
    price = F.when(F.col("l_linenumber") == 7, -1.0).otherwise(1.0 + F.col("l_extendedprice") / 10000.0)
    outcome = F.struct(F.col("l_returnflag").alias("name"), price.alias("price"))
    key = F.when(F.col("l_linestatus") == "O", "h2h").otherwise(F.when(F.col("l_linenumber") <= 4, "h2h").otherwise("totals"))
    market = F.struct(key.alias("key"), F.array(outcome).alias("outcomes"))
    book = F.struct(F.array(market).alias("markets"))
    lines = fan_out(w.table(spark, sf, "lineitem").select(
        "l_partkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_extendedprice"
    ))
    return lines.select(
        F.col("l_partkey").alias("event_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("payload_order"),
        _payload(F.lit("A").alias("home_team"), F.lit("R").alias("away_team"), F.array(book).alias("bookmakers")),
    )


def market_events(spark, sf):
    """Market events named after the fixtures' teams, one per part."""
    teams = w.TEAMS
    def name(offset: int) -> Column:
        index = F.pmod(F.col("p_partkey") * offset + F.floor(F.col("p_partkey") / 7), F.lit(len(teams)))
        return F.element_at(F.array(*[F.lit(t) for t in teams]), (index + 1).cast("int"))

    return w.table(spark, sf, "part").select(
        F.col("p_partkey").alias("event_id"), F.col("p_partkey").alias("payload_order"),
        _payload(F.concat(F.lit("FC "), name(1)).alias("home_team"), F.concat(name(3), F.lit(" United")).alias("away_team")),
    )
