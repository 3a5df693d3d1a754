"""Verdicts, readings, market, priors, health."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from terrace.operators import consistency, health, market, narrative, priors
from terrace.schemas import EMOTION_COLUMNS

FIXTURE = "fixture_id STRING, home_team STRING, away_team STRING, score STRING"
KEEPERS = "fixture_id STRING, team STRING, team_order INT, keeper STRING, saves DOUBLE, shots_faced DOUBLE"
THREAT = "fixture_id STRING, delta_xg_10min DOUBLE"


def mood_row(rows, side, dominant, volume=40, coverage=0.9):
    shares = [0.6 if c == f"emo_{dominant}" else 0.05 for c in EMOTION_COLUMNS]
    return rows([("F", side, "Mexico" if side == "home" else "South Africa", dominant, *shares, volume, coverage)],
                "fixture_id STRING, side STRING, team STRING, dominant STRING, " + ", ".join(f"{c} DOUBLE" for c in EMOTION_COLUMNS) + ", volume BIGINT, coverage DOUBLE")


def verdict(rows, score, dominant, saves=None):
    keepers = rows([("F", "Mexico", 0, "Ochoa", float(saves), 8.0)] if saves else [], KEEPERS)
    context = consistency.game_context(rows([("F", "Mexico", "South Africa", score)], FIXTURE), rows([("F", 0.4)], THREAT), keepers)
    return consistency.mood_verdicts(mood_row(rows, "home", dominant), context)


def test_game_context(rows):
    got = {r.side: r for r in consistency.game_context(rows([("F", "Mexico", "South Africa", "2-0")], FIXTURE), rows([], THREAT), rows([], KEEPERS)).collect()}
    assert (got["home"].status, got["away"].status, got["away"].margin, got["home"].threat) == ("leading", "trailing", 2, 0.0)
    bad = consistency.game_context(rows([("F", "A", "B", "junk")], FIXTURE), rows([], THREAT), rows([], KEEPERS)).collect()
    assert {r.status for r in bad} == {"level"}


@pytest.mark.parametrize("score,dominant,saves,expected,words", [
    ("0-2", "joy", None, "conflict", "overreaction"), ("0-2", "panic", None, "consistent", "trailing"),
    ("2-0", "panic", None, "conflict", "siege"), ("1-0", "panic", 6, "consistent", "keeper is busy (6 saves)"),
    ("1-1", "joy", None, "consistent", "level"),
])
def test_verdicts(rows, score, dominant, saves, expected, words):
    got = verdict(rows, score, dominant, saves)
    row = got.first()
    assert row.verdict == expected and words in row.explanation
    assert consistency.conflict_moments(got).count() == (expected == "conflict")


def test_clarity(rows):
    full = consistency.with_clarity(mood_row(rows, "home", "panic", 60, 1.0)).first().clarity
    assert full == round(0.5 * (0.6 - 0.05) + 0.3 + 0.2, 4)
    assert consistency.with_clarity(mood_row(rows, "home", "panic", 2, 0.2)).first().clarity < full


STATE = ("fixture_id STRING, minute BIGINT, crowd_panic_score DOUBLE, delta_xg_10min DOUBLE, arbitrage_index DOUBLE, "
         "dominant_emotion STRING, emotional_volatility DOUBLE, emo_anger DOUBLE")


def state(rows, panic=0.0, stability=0.5, index=0.1, dominant="neutral", volatility=0.1, anger=0.0):
    return rows([("F", 60, panic, stability, index, dominant, volatility, anger)], STATE)


NOTE = "fixture_id STRING, note STRING"
BUSY = "fixture_id STRING, keeper STRING, saves DOUBLE, shots_faced DOUBLE"


@pytest.mark.parametrize("change,threshold,expected", [
    (dict(panic=0.8, index=0.7, dominant="panic"), 0.35, ["Market overreaction signal", "Keeper holding the line"]),
    (dict(panic=-0.6, stability=0.1), 0.9, ["Complacency risk"]),
    (dict(anger=0.5), 0.9, ["Anger-driven sentiment"]), (dict(volatility=0.5), 0.9, ["Unstable crowd mood"]),
    (dict(), 0.9, ["Sentiment aligned with match state"]),
])
def test_takeaways(rows, change, threshold, expected):
    note = rows([("F", " Pitch data - Mexico: 61% possession, 5 on target.")], NOTE)
    got = narrative.takeaways(state(rows, **change), threshold, note, rows([("F", "Ochoa", 4.0, 7.0)], BUSY)).orderBy("position").collect()
    assert [r.headline for r in got] == expected
    if expected[0].startswith("Sentiment"):
        assert "(panic +0.00, xG stability 0.50)" in got[0].detail and "61%" in got[0].detail
    if len(expected) == 2:
        assert "Ochoa has made 4 saves from 7 shots faced" in got[1].detail


def test_headline(rows):
    got = narrative.headlines(state(rows, panic=0.8, stability=0.1, index=0.7), 0.35, mood_row(rows, "home", "panic")).first().headline
    assert got == ("Right now: fans are anxious while the match itself is fairly quiet — fans are spiking faster than the "
                   "pitch justifies — a possible overreaction. Mexico fans: panic.")


def test_underdog(rows):
    fx = rows([("F", "Mexico", "South Africa", "0–1"), ("G", "A", "B", "1-1"), ("H", "A", "B", "2-2")], FIXTURE)
    now = rows([("F", 70, 0.45), ("G", 10, 0.1), ("H", 5, 0.9)], "fixture_id STRING, minute BIGINT, delta_xg_10min DOUBLE")
    table = rows([("F", "Mexico", "shotsOnTarget", "4"), ("G", "B", "shotsOnTarget", "0")], "fixture_id STRING, team STRING, stat STRING, value STRING")
    keepers = rows([("F", "South Africa", 1, "Z", 5.0, 6.0)], KEEPERS)
    quoted = rows([("G", 0.5, 0.3)], "fixture_id STRING, home_prob DOUBLE, away_prob DOUBLE")
    got = narrative.underdog_evidence(fx, now, table, keepers, quoted).collect()
    assert [(r.fixture_id, r.underdog, r.evidence) for r in got] == [("F", "Mexico",
        "4 shots on target; live attacking threat 0.45; South Africa's keeper has needed 5 saves to keep this scoreline")]


def test_market(rows):
    odds = rows([(1, 0, "Mexico", 2.0), (1, 1, "South Africa", 4.0), (1, 2, "Mexico", 2.4), (1, 3, "South Africa", 3.6), (1, 4, "Draw", 4.0)],
                "event_id INT, feed_order INT, outcome STRING, price DOUBLE")
    prices = market.consensus_prices(odds)
    assert {r.outcome: r.price for r in prices.collect()} == pytest.approx({"Mexico": 2.2, "South Africa": 3.8, "Draw": 4.0})
    row = market.market_rows(market.implied_probabilities(prices), rows([(1, "Mexico", "South Africa")], "event_id INT, home_team STRING, away_team STRING")).first()
    assert row.favorite == "Mexico" and row.home_prob > row.away_prob
    assert row.home_prob + row.draw_prob + row.away_prob == pytest.approx(1.0, abs=1e-3)


@pytest.mark.parametrize("panic,certainty,expected", [(0.8, 0.75, 0.6), (-0.5, 0.5, 0.25), (0.0, 0.9, 0.0)])
def test_divergence(spark, panic, certainty, expected):
    assert spark.range(1).select(market.divergence(F.lit(panic), F.lit(certainty))).first()[0] == expected


SCHEDULE = [("Mexico", "South Africa", "2-0"), ("South Korea", "Czechia", "1–1"), ("Mexico", "Czechia", None), ("A", "B", "abandoned")]


def test_priors(rows):
    table = priors.team_priors(rows(SCHEDULE, "home_team STRING, away_team STRING, score STRING"))
    got = {r.team: r for r in table.collect()}
    assert set(got) == {"Mexico", "South Africa", "South Korea", "Czechia"}
    assert (got["Mexico"].matches_played, got["Mexico"].goals_for_per_match, got["Mexico"].goals_against_per_match) == (1, 2.0, 0.0)
    assert got["Mexico"].xg_for_per_match is None
    pairs = rows([("F", "mexico ", "South Africa"), ("G", "Atlantis", "Mordor"), ("H", "Atlantis", "Czechia")], "fixture_id STRING, home_team STRING, away_team STRING")
    found = {r.fixture_id: r.edge for r in priors.fixture_prior(pairs, table).collect()}
    assert found == {"F": 4.0, "H": None}


def test_priors_from_statistics_alone(rows):
    season = rows([("A", 2, 3.0, 55.0), ("B", 0, 1.5, None)], "team STRING, played INT, xg DOUBLE, possession DOUBLE")
    got = {r.team: r for r in priors.team_priors(rows([], "home_team STRING, away_team STRING, score STRING"), season).collect()}
    assert got["A"].xg_for_per_match == 1.5 and got["B"].xg_for_per_match == 1.5 and got["A"].matches_played is None


KICKOFF = datetime(2026, 6, 11, 19)


@pytest.mark.parametrize("state_,minutes,seen,expected", [
    ("pre", 0, None, "pre"), ("in", 60, None, "live"), ("post", 120, 120, "post-window"), ("post", 136, 120, "frozen"),
    ("post", 300, None, "frozen"), ("post", 150, None, "post-window"),
])
def test_capture_phase(rows, state_, minutes, seen, expected):
    df = rows([(state_, KICKOFF, KICKOFF + timedelta(minutes=minutes), KICKOFF + timedelta(minutes=seen) if seen else None)],
              "state STRING, k TIMESTAMP, now TIMESTAMP, seen TIMESTAMP")
    assert df.select(health.capture_phase(F.col("state"), F.col("k"), F.col("now"), F.col("seen"))).first()[0] == expected


def test_capture_pick(rows):
    board = rows([("a", "post", KICKOFF, 0), ("b", "in", KICKOFF, 1), ("c", "in", KICKOFF, 2)], "fixture_id STRING, state STRING, kickoff_utc TIMESTAMP, feed_order INT")
    def at(m):
        return F.lit(str(KICKOFF + timedelta(minutes=m))).cast("timestamp")

    assert health.capture_pick(board, at(150)).first().fixture_id == "b"
    done = board.filter("state = 'post'")
    assert health.capture_pick(done, at(150)).first().fixture_id == "a"
    assert health.capture_pick(done, at(200)).count() == 0 and health.live_pick(done).count() == 0


def test_freshness_levels(rows):
    schema = "match_id STRING, last_run_utc STRING, source STRING, live BOOLEAN, n_reactions BIGINT, reactions_by_source MAP<STRING, BIGINT>"
    at = "2026-06-11T19:00:00+00:00"
    df = rows([("1", at, "live", True, 0, {}), ("2", at, "simulator", False, 5, {"s": 5}), ("3", at, "live", True, 5, {"a": 3, "b": 2}), ("4", "bad", "live", True, 5, {})], schema)
    def levels(minute):
        now = F.lit(str(KICKOFF + timedelta(minutes=minute))).cast("timestamp")
        return {r.match_id: (r.level, r.detail) for r in health.freshness(df, now).collect()}

    early, late = levels(10), levels(26)
    assert early["1"][0] == "no-data" and early["2"] == ("degraded", "No live match captured — showing simulator data (10 min ago).")
    assert early["3"] == ("live", "5 reactions (a 3, b 2); updated 10 min ago.") and late["3"][0] == "stale"
    assert early["4"] == ("live", "5 reactions (no sources); updated unknown age.")


def test_run_health(rows):
    chat = rows([("ESPN-1", "a"), ("ESPN-1", "b"), ("ESPN-1", "b")], "fixture_id STRING, source STRING")
    lines = rows([("ESPN-1", "x")], "fixture_id STRING, line STRING")
    runs = rows([("ESPN-1",), ("SIM-2",)], "fixture_id STRING")
    got = {r.match_id: r for r in health.run_health(chat, lines, runs, F.lit("2026-06-11 19:00:00").cast("timestamp")).collect()}
    assert got["ESPN-1"].reactions_by_source == {"b": 2, "a": 1} and got["ESPN-1"].fetch_ok
    assert (got["SIM-2"].source, got["SIM-2"].live, got["SIM-2"].n_reactions) == ("simulator", False, 0)
    assert got["ESPN-1"].last_run_utc == "2026-06-11T19:00:00+00:00"
