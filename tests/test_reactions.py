"""Cleaning, buffers, minutes, attribution, containment, back-fill."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from terrace import workload as w
from terrace.operators import attribution, cleaning, containment, market, minutes
from terrace.operators.backfill import match_to_fixtures
from terrace.plans.backfill import backfill

SF = "/root/testdata/sf0.001"
START = datetime(2031, 3, 4, 18)
RAW = "fixture_id STRING, created_utc TIMESTAMP, message STRING, source STRING, author STRING, ingest_seq BIGINT, terms ARRAY<STRING>"
TERMS = ["Norhaven", "Velmora"]


def posts(rows, messages, author="", start=START, step=10, fixture="F1", first=0):
    authors = author if isinstance(author, list) else [author] * len(messages)
    return rows(
        [(fixture, start + timedelta(seconds=step * i), m, "s", a, first + i, TERMS) for i, (m, a) in enumerate(zip(messages, authors))],
        RAW,
    )


def test_clean_reactions_filters(rows):
    df = posts(rows, [
        "Norhaven cannot string two passes together", "🎺🎺", "https://example.org/clip", "my train home runs late",
        "tidy corner routine from Velmora", "Line-ups for Norhaven and Velmora",
    ], ["ola", "pip", "quin", "rae", "sol", "NightBot"])
    kept = {r.message for r in cleaning.clean_reactions(df, "terms").collect()}
    assert kept == {"Norhaven cannot string two passes together", "tidy corner routine from Velmora"}


def test_author_flood_capped_after_dedup_and_blank_exempt(rows):
    flood = posts(rows, [f"Norhaven attack number {i // 2}" for i in range(40)], "loud")
    assert sorted(r.ingest_seq for r in cleaning.clean_reactions(flood, "terms").collect()) == [0, 2, 4, 6, 8]
    blank = posts(rows, [f"Norhaven attack number {i}" for i in range(20)], "  ")
    assert cleaning.clean_reactions(blank, "terms").count() == 20


def test_survivor_of_copies_is_first_ingested_not_earliest(rows):
    df = rows([
        ("F1", START + timedelta(minutes=5), "that PENALTY again", "s", "a", 1, TERMS),
        ("F1", START, "that penalty again", "s", "b", 2, TERMS),
        ("F2", START, "that penalty again", "s", "c", 3, TERMS),
    ], RAW)
    assert sorted(r.ingest_seq for r in cleaning.drop_copies(df).collect()) == [1, 3]


def test_no_gate_and_empty_terms_pass_all(rows):
    df = posts(rows, ["my train home runs late"])
    assert cleaning.clean_reactions(df).count() == 1
    assert cleaning.clean_reactions(df.withColumn("terms", F.array().cast("array<string>")), "terms").count() == 1


def test_newest_caps_per_fixture_and_breaks_ties_by_ingest(rows):
    df = posts(rows, [f"m {i}" for i in range(1200)])
    kept = cleaning.newest(df)
    assert kept.count() == 1000 and kept.agg(F.min("ingest_seq")).first()[0] == 200
    same = posts(rows, ["a", "b", "c"], step=0)
    assert sorted(r.message for r in cleaning.newest(same, 2).collect()) == ["b", "c"]


def test_newest_beyond_the_group_limit(rows):
    """More rows than the limit, seconds cut in the middle, equal times, a null time last, a null key."""
    raw = [("F1" if i % 7 else None, START + timedelta(seconds=i // 400, microseconds=i % 3), i) for i in range(4000)] + [("F2", None, 9000), ("F2", START, 9001)]
    df = rows(raw, "fixture_id STRING, created_utc TIMESTAMP, ingest_seq BIGINT")
    got = {(r.fixture_id, r.ingest_seq) for r in cleaning.newest(df, 1500).collect()}
    want = set()
    for key in ("F1", "F2", None):
        mine = sorted((r for r in raw if r[0] == key), key=lambda r: (r[1] is not None, r[1] or START, r[2]), reverse=True)
        want |= {(r[0], r[2]) for r in mine[:1500]}
    assert got == want and len(got) == 1500 + 2 + 572


def test_merge_buffer_accumulates_caps_and_prior_wins(rows):
    prior = posts(rows, [f"keeper punts it, take {i}" for i in range(600)], "old", step=5)
    new = posts(rows, [f"corner count {i}" for i in range(600)], "new", start=START + timedelta(hours=2), step=5)
    merged = cleaning.merge_buffer(prior, new)
    # 111, 222, ... collapse into 11, 22, ...: 595 distinct messages of 600
    assert merged.count() == 1000 and merged.filter("author = 'new'").count() == 595
    again = cleaning.merge_buffer(prior, prior.withColumn("author", F.lit("copy")))
    assert again.count() == 595 and again.filter("author = 'copy'").count() == 0


def test_posts_to_chat_minutes(rows):
    fixtures = rows([("F1", START)], "fixture_id STRING, kickoff_utc TIMESTAMP")
    times = [timedelta(hours=-2), timedelta(minutes=-10), timedelta(minutes=57, seconds=30), timedelta(hours=5)]
    df = rows([("F1", START + t, str(i)) for i, t in enumerate(times)], "fixture_id STRING, created_utc TIMESTAMP, message STRING")
    got = {r.message: r.minute for r in minutes.posts_to_chat(df, fixtures).collect()}
    assert got == {"1": 0, "2": 57, "3": 130}


def test_team_tokens_words_stop_words_and_aliases(spark):
    names = ["Spain Under Nine", "Korea Republic", "Croatia", "", None, "Ilo"]
    df = spark.createDataFrame([(n,) for n in names], "n STRING")
    got = [set(r[0]) for r in df.select(attribution.team_tokens(F.col("n"))).collect()]
    assert got[0] == {"spain under nine", "spain", "under", "nine", "espana", "españa", "la roja"}
    assert got[1] == {"korea republic", "korea", "south korea", "taeguk"}
    assert got[2] == {"croatia", "hrvatska", "vatreni"}
    assert got[3:] == [set(), set(), {"ilo"}]


def test_tags_and_side_mood(rows):
    fixtures = rows([("F1", "Croatia", "Velmora"), ("F2", "A", "")], "fixture_id STRING, home_team STRING, away_team STRING")
    df = posts(rows, ["vatreni in red", "velmora sit deep", "Croatia meet Velmora", "quiet street"])
    tagged = attribution.tag_teams(df, fixtures)
    assert {r.ingest_seq: r.team for r in tagged.collect()} == {0: "home", 1: "away", 2: "both", 3: "neither"}
    assert attribution.attribution_coverage(tagged).first().attributed == 0.75
    shared = tagged.select("fixture_id", "team", *[F.lit(1.0 if c == "emo_joy" else 0.0).alias(c) for c in attribution.EMOTION_COLUMNS])
    mood = {(r.fixture_id, r.side): r for r in attribution.side_mood(shared, fixtures).collect()}
    assert mood["F1", "home"].volume == 2 and mood["F1", "home"].dominant == "joy" and mood["F1", "home"].coverage == 1.0
    assert mood["F2", "away"].volume == 0 and mood["F2", "away"].dominant == "neutral" and mood["F2", "away"].team == "away"


def test_containment_join_against_brute_force(rows):
    texts = ["we roll downhill now", "nieve otra vez 🎺🎺", "ab", "", "under the bridge and over the hill"]
    terms = ["roll", "we roll", "nieve", "nieve otra", "🎺", "a", "ab", "the ", "zzz"]
    df = rows(list(enumerate(texts)), "id INT, text STRING")
    table = rows([(t,) for t in terms], "term STRING")
    got = {(r.id, r.term) for r in containment.containment_join(df, "id", "text", table, "term").collect()}
    assert got == {(i, t) for i, x in enumerate(texts) for t in terms if t in x}


def test_containment_of_no_text_and_no_terms(rows):
    df = rows([(1, None), (2, ""), (3, "a bridge 🎺🎺 afar")], "id INT, text STRING")
    table = rows([("",), ("🎺🎺 a",), ("🎺🎺 a",), ("far away",)], "term STRING")
    assert [(r.id, r.term) for r in containment.containment_join(df, "id", "text", table, "term").collect()] == [(3, "🎺🎺 a")] * 2
    assert containment.containment_join(df, "id", "text", table.limit(0), "term").count() == 0
    assert containment.containment_join(df.limit(0), "id", "text", table, "term").count() == 0


def test_few_runs_pass_the_filter(spark, rows):
    docs = w.documents(spark, SF).select("doc_id", F.lower("text").alias("low"))
    terms = rows([(t,) for words in w.LEXICON.values() for t in words], "term STRING").distinct()
    anchored = containment.anchored_terms(docs, "low", terms, "term").cache()
    hits = containment.anchor_hits(docs, "doc_id", "low", anchored).count()
    pairs = containment.containment_join(docs, "doc_id", "low", terms, "term").count()
    assert anchored.count() == terms.count() and pairs > 0
    assert hits < 2 * pairs


def test_a_post_meets_only_fixtures_of_its_hour_and_teams(rows):
    names = "fixture_id STRING, home_team STRING, away_team STRING, kickoff_utc TIMESTAMP"
    fixtures = rows([("F1", "Norhaven", "Velmora", START), ("F2", "VELMORA", "Velmora", START), ("F3", "Orsk", "Brenna", START), ("F4", None, "Alda", START)], names)
    texts = ["velmora and norhaven", "Velmora only", "nobody", None, "brenna, ORSK, alda"]
    df = rows([(START, t, i) for i, t in enumerate(texts)], "created_utc TIMESTAMP, message STRING, ingest_seq BIGINT")
    got = match_to_fixtures(df, fixtures)
    assert got.columns == ["created_utc", "message", "ingest_seq", "fixture_id", "terms"]
    assert sorted((r.ingest_seq, r.fixture_id) for r in got.collect()) == [(0, "F1"), (0, "F2"), (1, "F1"), (1, "F2"), (4, "F3"), (4, "F4")]
    assert match_to_fixtures(df, fixtures.limit(0)).count() == 0 and match_to_fixtures(df.limit(0), fixtures).count() == 0


def test_market_event_first_in_feed_order(rows):
    fixtures = rows([("F1", "Norhaven", "Velmora"), ("F2", "Alda", "Orsk"), ("F3", "", "Orsk")], "fixture_id STRING, home_team STRING, away_team STRING")
    events = rows([
        (3, 30, "Velmora", "Norhaven"), (1, 10, "Norhaven B", "Velmora B"), (2, 5, "Orsk", "Brenna"),
    ], "event_id INT, feed_order INT, home_team STRING, away_team STRING")
    got = {r.fixture_id: r.event_id for r in market.match_events(fixtures, events).collect()}
    assert got == {"F1": 1, "F3": 2}


def test_backfill_matches_window_and_terms(rows):
    fixtures = rows([("F1", "Norhaven", "unknown", START), ("F2", "unknown", "", START)], "fixture_id STRING, home_team STRING, away_team STRING, kickoff_utc TIMESTAMP")
    offsets = [-16, -15, 0, 130, 131]
    df = rows([(START + timedelta(minutes=m), f"NORHAVEN corner number {m}", "s", "a", i) for i, m in enumerate(offsets)] + [(START, "empty stands", "s", "b", 9)],
              "created_utc TIMESTAMP, message STRING, source STRING, author STRING, ingest_seq BIGINT")
    assert sorted(r.ingest_seq for r in match_to_fixtures(df, fixtures).collect()) == [1, 2, 3]
    keyed = backfill(df, fixtures).collect()
    assert sorted((r.minute, r.team) for r in keyed) == [(0, "home"), (0, "home"), (130, "home")]


def test_matching_with_texts_moves_no_message_with_the_hours(rows):
    kickoff = datetime(2026, 6, 11, 19)
    fixtures = rows([("A", kickoff, "Spain", "Japan"), ("B", kickoff + timedelta(hours=1), "Japan", "Peru")], "fixture_id STRING, kickoff_utc TIMESTAMP, home_team STRING, away_team STRING")
    texts = rows([(0, "what a goal by Spain"), (1, "Japan must win the game"), (2, None), (3, "nobody plays here"), (4, "WHAT a goal by Spain"), (0, "two texts of one key: Peru")], "doc_id INT, message STRING")
    posts = rows([(i, kickoff + timedelta(minutes=7 * i), "s", f"u{i % 3}", i % 6) for i in range(30)], "ingest_seq INT, created_utc TIMESTAMP, source STRING, author STRING, doc_id INT")
    whole = posts.join(texts, "doc_id")

    slim = match_to_fixtures(posts, fixtures, texts)
    names = sorted(slim.columns)
    assert names == sorted(match_to_fixtures(whole, fixtures).columns)
    assert sorted(map(str, slim.select(names).collect())) == sorted(map(str, match_to_fixtures(whole, fixtures).select(names).collect()))
    def outermost(df):
        return next(line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line)

    assert "doc_id" in outermost(slim) and "_bucket" not in outermost(slim) and "_bucket" in outermost(match_to_fixtures(whole, fixtures))
    a, b = backfill(posts, fixtures, texts), backfill(whole, fixtures)
    assert a.columns == b.columns and a.count() > 0
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_backfill_keeps_more_than_a_window_of_reactions(rows):
    """The back-fill query's check SQL knows no newest 1,000: every clean reaction of a fixture is stored."""
    many = 1200
    fixtures = rows([("F", START, "Norhaven", "Sudport")], "fixture_id STRING, kickoff_utc TIMESTAMP, home_team STRING, away_team STRING")
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    texts = rows([(i, f"norhaven wins {letters(i)}") for i in range(many)], "doc_id INT, message STRING")
    posts = rows([(i, START + timedelta(seconds=i % 5), "s", f"u{i % 400}", i) for i in range(many)], "ingest_seq INT, created_utc TIMESTAMP, source STRING, author STRING, doc_id INT")
    assert backfill(posts, fixtures, texts).count() == many
    assert backfill(posts.join(texts, "doc_id"), fixtures).count() == many
