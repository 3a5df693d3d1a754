"""Mood and threat series, divergence, situations, alerts."""

import math

import pytest
from pyspark.sql import functions as F

from terrace.operators import alerts, minutes, mood, selector, situation, threat
from terrace.schemas import EMOTION_COLUMNS

CHAT = "fixture_id STRING, minute BIGINT, message STRING"


def test_minute_profile_is_dense_and_carries_volume(rows):
    df = rows([("F", 0, "panic everywhere"), ("F", 0, "we're done"), ("F", 3, "cruising now"), ("G", 2, "golazo")], CHAT)
    got = mood.minute_profile(df).orderBy("fixture_id", "minute").collect()
    f = [r for r in got if r.fixture_id == "F"]
    g = [r for r in got if r.fixture_id == "G"]
    assert [r.minute for r in f] == [0, 1, 2, 3] and [r.comment_volume for r in f] == [2, 2, 2, 1]
    assert f[1].emo_panic == f[0].emo_panic == 1.0 and f[3].emo_confidence == 1.0
    assert [(r.minute, r.comment_volume, r.emo_joy) for r in g] == [(0, 0, 0.0), (1, 0, 0.0), (2, 1, 1.0)]


def test_shares_normalise_and_silent_stays_zero(rows):
    df = mood.emotion_shares(mood.emotion_intensities(rows([("panic and golazo",), ("nice weather",)], "message STRING")))
    totals = [sum(r[c] for c in EMOTION_COLUMNS) for r in df.collect()]
    assert totals == [pytest.approx(1.0), 0.0]


def test_emotion_series_bounds_labels_and_volatility(rows):
    df = rows([("F", 0, "panic!!"), ("F", 1, "golazo what a goal"), ("F", 2, "panic again"), ("F", 3, "cruising easy")], CHAT)
    got = mood.emotion_series(df).orderBy("minute").collect()
    assert [r.dominant_emotion for r in got] == ["panic", "joy", "panic", "confidence"]
    assert [r.emotional_volatility for r in got] == pytest.approx([0, 1 / 2, 2 / 3, 3 / 4])
    first = math.tanh(2 * 1.2)
    assert got[0].crowd_panic_score == pytest.approx(first)
    assert got[1].crowd_panic_score == pytest.approx((first + math.tanh(-2 * 0.9)) / 2)


def test_simple_series_fills_and_smooths(rows):
    data = [(0, "total panic we are done"), (0, "disaster, choking again"), (1, "we look comfortable"), (3, "panic panic panic")]
    got = mood.simple_series(rows([("F", m, t) for m, t in data], CHAT), window=2).orderBy("minute").collect()
    assert [r.minute for r in got] == [0, 1, 2, 3]
    calm = math.tanh(-0.7)
    assert got[2].crowd_panic_score == pytest.approx(calm)
    assert got[3].crowd_panic_score == pytest.approx((calm + math.tanh(3.0)) / 2)


def test_scored_share(rows):
    df = mood.emotion_intensities(rows([("F", "panic now"), ("F", "nice weather today")], "fixture_id STRING, message STRING"))
    assert mood.scored_share(df).first().coverage == 0.5


LINES = "fixture_id STRING, line STRING"


def test_parse_commentary(rows):
    data = [
        "16' Orsk: long ball saved on the line", "45+4' Alda: goal after a scramble", "rain is falling here",
        "51' Orsk: slow build-up", "9' Corner on the left.", None, "3' Été Club: penalty given",
    ]
    got = threat.parse_commentary(rows([("F", x) for x in data], LINES)).collect()
    assert [(r.minute, r.team, r.event_type, r.xg_value) for r in got] == [
        (16, "Orsk", "shot_on_target", 0.30), (45, "Alda", "goal", 0.40), (51, "Orsk", "play", 0.0),
        (9, "unknown", "corner", 0.03), (3, "unknown", "penalty", 0.76),
    ]


def test_first_pattern_wins(rows):
    got = threat.parse_commentary(rows([("F", "1' A: goal from the penalty spot"), ("F", "2' A: great save, corner")], LINES)).collect()
    assert [r.event_type for r in got] == ["goal", "shot_on_target"]


def test_threat_is_dense_and_bounded(rows):
    got = threat.threat_series(rows([("F", f"{m}' Orsk: low drive saved") for m in range(0, 30, 3)], LINES)).orderBy("minute").collect()
    assert [r.minute for r in got] == list(range(28))
    assert got[1].rolling_xg == pytest.approx(0.3) and got[27].rolling_xg == pytest.approx(1.2)
    assert all(0 <= r.delta_xg_10min <= 1 for r in got)


def test_selector_flags_and_fills(rows):
    social = rows([("F", 0, 0.0), ("F", 1, 0.9), ("F", 2, 0.1)], "fixture_id STRING, minute BIGINT, crowd_panic_score DOUBLE")
    match = rows([("F", 0, 0.0, 0.0), ("F", 1, 0.05, 0.05), ("F", 4, 0.05, 0.5)], "fixture_id STRING, minute BIGINT, rolling_xg DOUBLE, delta_xg_10min DOUBLE")
    got = selector.select_moments(social, match, 0.5).orderBy("minute").collect()
    assert [r.flagged for r in got] == [False, True, False, False]
    assert got[1].arbitrage_index == pytest.approx(0.9 * 0.95)
    assert got[2].delta_xg_10min == 0.05 and got[3].crowd_panic_score == 0.1


def test_index_clips(spark):
    got = spark.range(1).select(selector.arbitrage_index(F.lit(5.0), F.lit(-3.0))).first()[0]
    assert got == 1.0


BASE = {"minute": 50, "crowd_panic_score": 0.0, "delta_xg_10min": 0.35, "emotional_volatility": 0.25, "arbitrage_index": 0.15,
        "rolling_xg": 0.4, "comment_volume": 5, "emo_confidence": 0.2}


@pytest.mark.parametrize("change,expected", [
    (dict(minute=57, crowd_panic_score=0.65, delta_xg_10min=0.55, emotional_volatility=0.35, arbitrage_index=0.65), "panic_divergence"),
    (dict(minute=62, crowd_panic_score=0.7, delta_xg_10min=0.1, emotional_volatility=0.45, arbitrage_index=0.2), "genuine_crisis"),
    (dict(crowd_panic_score=-0.6, delta_xg_10min=0.6, emotional_volatility=0.15), "cruise_control"),
    (dict(crowd_panic_score=-0.05, delta_xg_10min=0.05, emotional_volatility=0.08, arbitrage_index=0.05), "dead_rubber"),
    (dict(minute=90, crowd_panic_score=0.35, delta_xg_10min=0.45, emotional_volatility=0.65, arbitrage_index=0.35), "late_drama"),
])
def test_situations(spark, change, expected):
    df = spark.createDataFrame([{**BASE, **change, "fixture_id": "F"}])
    got = situation.classify(df).first()
    assert got.situation == expected and 0 <= got.situation_confidence <= 1


def test_situation_tolerates_missing_columns_and_key_metrics(spark):
    assert situation.classify(spark.createDataFrame([(30,)], "minute INT")).first().situation in situation.PROTOTYPES
    state = situation.classify(spark.createDataFrame([{**BASE, "fixture_id": "F"}, {**BASE, "minute": 51, "rolling_xg": None, "fixture_id": "F"}]))
    got = situation.key_metrics(state).orderBy("position").collect()
    assert [(r.metric, r.label) for r in got] == [("delta_xg_10min", "xG Stability"), ("crowd_panic_score", "Crowd Panic")]


def test_brief_defaults(spark):
    got = situation.with_brief(spark.createDataFrame([("wild_end",), ("",)], "situation STRING")).collect()
    assert [(r.label, r["metrics"][0]) for r in got] == [("Wild End", "arbitrage_index"), ("Unknown", "arbitrage_index")]


def test_minute_change_and_flags(rows):
    state = rows([("F", 0, 0.1, 0.2, 0.3, True), ("F", 1, 0.4, 0.1, 0.9, True), ("G", 0, 0.5, 0.5, 0.1, False)],
                 "fixture_id STRING, minute BIGINT, crowd_panic_score DOUBLE, delta_xg_10min DOUBLE, arbitrage_index DOUBLE, flagged BOOLEAN")
    got = {r.fixture_id: r for r in selector.minute_change(state).collect()}
    assert got["F"].crowd_panic_score_change == pytest.approx(0.3) and got["G"].arbitrage_index_change == 0.0
    assert [r.minute for r in selector.flagged_by_index(state, 1).collect()] == [1]
    assert {r.fixture_id: r.flagged_minutes for r in selector.flag_counts(state).collect()} == {"F": 2, "G": 0}


def test_alert_gap(rows):
    df = rows([("F", m) for m in (3, 5, 17, 18, 33, 40, 48, 48)], "fixture_id STRING, minute BIGINT")
    assert sorted(r.minute for r in alerts.throttle(df).collect()) == [3, 18, 33, 48]


def test_bad_minute_stamps_do_not_end_the_job(spark):
    """No-break spaces count as blanks; impossible stamps are set aside with their line."""
    from terrace.operators.threat import parse_commentary, quarantined_lines

    lines = spark.createDataFrame([(1, " 7' Ajax : goal!"), (2, "9" * 20 + "' Ajax: corner"), (3, "99999999' Ajax: corner"), (4, "8' Ajax: corner")], "seq INT, line STRING")
    assert sorted((r.seq, r.minute, r.team, r.event_type) for r in parse_commentary(lines).collect()) == [(1, 7, "Ajax", "goal"), (4, 8, "Ajax", "corner")]
    assert sorted((r.seq, r.reason) for r in quarantined_lines(lines).collect()) == [(2, "impossible minute"), (3, "impossible minute")]


def test_bad_minutes_are_set_aside_by_the_dense_axis(rows):
    """One fixture's bad minutes neither end the job nor stretch it; the others are whole."""
    df = rows([("F", 1, 0.5), ("F", 10**15, 9.0), ("F", -4, 9.0), ("F", None, 9.0), ("G", 2, 0.25), ("H", 5000, 1.0)], "fixture_id STRING, minute BIGINT, xg_value DOUBLE")
    got = sorted((r.fixture_id, r.minute, r.xg_value) for r in minutes.zero_filled(df, ["xg_value"]).collect())
    assert got == [("F", 0, 0.0), ("F", 1, 0.5), ("G", 0, 0.0), ("G", 1, 0.0), ("G", 2, 0.25)]
    aside = {(r.fixture_id, r.minute): r.reason for r in minutes.set_aside(df).collect()}
    assert aside == {("F", 10**15): "impossible minute", ("F", -4): "negative minute", ("F", None): "no minute", ("H", 5000): "impossible minute"}
    poisoned = rows([("F", "3' Orsk: goal"), ("F", "4000' Orsk: goal"), ("G", "2' Alda: corner")], LINES)
    assert sorted((r.fixture_id, r.minute) for r in threat.threat_series(poisoned).collect()) == [("F", m) for m in range(4)] + [("G", m) for m in range(3)]
