"""Archive, fit, streaming, whole jobs, plan shapes and the registry contract."""

import math
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import __spark_entry__ as contract
from terrace import workload as w
from terrace.functions.text import word_grams
from terrace.operators import archive, charmodel, fitting, mood, regression, textmodel
from terrace.operators.minutes import posts_to_chat
from terrace.plans import ingest, nightly, training
from terrace.registry import job_queries, text_queries
from terrace.registry.reaction_queries import _with_terms
from terrace.operators import cleaning
from terrace.session import configure
from terrace.sources import tables
from terrace.streaming import live, state

SF = "/root/testdata/sf0.001"
RAW = "fixture_id STRING, ingest_seq BIGINT, minute DOUBLE, crowd_panic_score DOUBLE, dominant_emotion STRING, comment_volume DOUBLE, flagged BOOLEAN"


def raw(rows, fixture="M1"):
    return rows([(fixture, 0, 0.0, -0.5, "panic", 3.0, False), (fixture, 1, 1.0, 1.5, None, 5.0, True), (fixture, 2, 2.0, None, "joy", None, None),
                 (fixture, 3, None, 0.0, None, 2.0, False), (fixture, 4, 0.0, 0.25, "neutral", -1.0, True)], RAW)


def test_validate_state(rows):
    got = archive.validate_state(raw(rows)).orderBy("minute").collect()
    assert [(r.minute, r.crowd_panic_score, r.dominant_emotion, r.comment_volume, r.flagged) for r in got] == [
        (0, 0.25, "neutral", 0, True), (1, 1.0, "neutral", 5, True), (2, 1.0, "joy", 5, False)]
    assert all(v is not None for r in got for v in r)
    assert archive.validate_state(raw(rows).withColumn("minute", F.lit(None).cast("double"))).count() == 0


def test_assert_archive_fails_the_job(rows):
    bad = archive.validate_state(raw(rows)).withColumn("emo_joy", F.lit(2.0))
    with pytest.raises(PySparkException, match="constraints"):
        archive.assert_archive(bad).count()


def test_upsert_is_idempotent_and_keeps_other_fixtures(spark, rows, tmp_path):
    path = str(tmp_path / "archive")
    for fixture in ("M1", "M2", "M1"):
        tables.upsert(archive.validate_state(raw(rows, fixture)), path, tables.MATCH_ARCHIVE)
    assert tables.load(spark, path, tables.MATCH_ARCHIVE).groupBy("match_id").count().orderBy("match_id").collect() == [("M1", 3), ("M2", 3)]
    old = archive.validate_state(raw(rows)).drop("situation", "situation_confidence")
    assert {(r.situation, r.situation_confidence) for r in archive.backfill_columns(old).collect()} == {("unknown", 0.0)}


def corpus(rows):
    data = []
    for match, block in (("E1", range(40, 60)), ("E2", range(50, 70))):
        for m in range(100):
            p = 0.8 if m in block else 0.0
            data.append((match, m, p, 0.05, p * 0.95))
    return rows(data, "match_id STRING, minute INT, crowd_panic_score DOUBLE, rolling_xg DOUBLE, arbitrage_index DOUBLE")


def test_fit_matches_brute_force(rows):
    df = corpus(rows)
    truth = [1.0 if r.crowd_panic_score > 0.4 else 0.0 for r in df.collect()]
    index = [r.arbitrage_index for r in df.collect()]

    def loss(t):
        total = 0.0
        for y, x in zip(truth, index):
            p = min(max(1 / (1 + math.exp(-8 * (x - t))), 1e-7), 1 - 1e-7)
            total -= y * math.log(p) + (1 - y) * math.log(1 - p)
        return total / len(truth)

    losses = {t: loss(t) for t in fitting.THRESHOLDS}
    best = min(losses, key=losses.get)
    got = fitting.fit_threshold(df).first()
    assert (got.threshold, got.evaluated_minutes, got.matches, got.status) == (best, 200, 2, "fitted")
    assert got.log_loss == pytest.approx(losses[best])
    grid = {r.threshold: r.log_loss for r in fitting.threshold_grid(fitting.corpus_truth(df)).collect()}
    assert grid == pytest.approx(losses)


def test_fit_guards(rows):
    df = corpus(rows)
    assert fitting.fit_threshold(df.filter("minute < 50")).first().status == "skipped: too few minutes"
    calm = fitting.fit_threshold(df.withColumn("crowd_panic_score", F.lit(0.0)), 0.5).first()
    assert (calm.status, calm.threshold) == ("skipped: one outcome class", 0.5)
    assert fitting.fit_threshold(df.limit(0)).first().threshold == 0.65


def test_lookahead_truth(rows):
    state = rows([("F", 10, 0.9), ("F", 50, 0.9), ("F", 14, 0.1)], "fixture_id STRING, minute BIGINT, crowd_panic_score DOUBLE")
    events = rows([("F", 15, "goal"), ("F", 51, "corner")], "fixture_id STRING, minute BIGINT, event_type STRING")
    got = {r.minute: r.overreaction for r in fitting.lookahead_truth(state, events).collect()}
    assert got == {10: 0.0, 50: 1.0, 14: 0.0}


START = datetime(2026, 6, 11, 19)


def write_ticks(rows, path, ticks):
    for i, messages in enumerate(ticks):
        data = [("F", START + timedelta(minutes=5 * i, seconds=j), m, "s", "", 100 * i + j) for j, m in enumerate(messages)]
        rows(data, live.BUFFER).coalesce(1).write.mode("append").parquet(path)


KICKOFFS = "fixture_id STRING, kickoff_utc TIMESTAMP"


def run_series(spark, rows, path, out):
    fixtures = rows([("F", START)], KICKOFFS)
    stream = live.landed_stream(spark, path, live.BUFFER, files_per_tick=1)
    changes = state.mood_changes(live.shared_chat(stream, fixtures))
    sizes = {}

    def step(batch, batch_id):
        sizes[batch_id] = batch.count()
        live.upsert_sink(f"{out}/series", live.MOOD_SERIES)(batch, batch_id)

    live.run_to_end(changes, step, f"{out}/cp", "update")
    return tables.load(spark, f"{out}/series", live.MOOD_SERIES).orderBy("minute").collect(), sizes


def test_stream_over_ticks_equals_batch(spark, rows, tmp_path):
    path = str(tmp_path / "in")
    write_ticks(rows, path, [["total panic", "golazo"], ["we're done", "cruising"], ["hopeless", "calm"]])
    # a late row of an earlier minute in a tick of its own
    rows([("F", START + timedelta(minutes=3), "hopeless", "s", "", 900)], live.BUFFER).coalesce(1).write.mode("append").parquet(path)
    got, sizes = run_series(spark, rows, path, str(tmp_path / "out"))
    chat = posts_to_chat(spark.read.parquet(path), rows([("F", START)], KICKOFFS))
    expected = mood.emotion_series(chat).orderBy("minute").collect()
    assert [r.minute for r in got] == [r.minute for r in expected] == list(range(11))
    for a, b in zip(got, expected):
        assert a.crowd_panic_score == pytest.approx(b.crowd_panic_score) and a.dominant_emotion == b.dominant_emotion
        assert a.comment_volume == b.comment_volume and a.emotional_volatility == pytest.approx(b.emotional_volatility)
    # a tick sends the minutes it changes: one, five more, five more; the late row's minute, the one it fills and the windows over both
    assert [sizes[i] for i in range(4)] == [1, 5, 5, 7]


def test_stream_replay_does_not_double(spark, rows, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_ticks(rows, path, [["total panic"]])
    for _ in range(2):
        got, _ = run_series(spark, rows, path, out)
        assert [r.comment_volume for r in got] == [1]
    live.upsert_sink(f"{out}/series", live.MOOD_SERIES)(tables.load(spark, f"{out}/series", live.MOOD_SERIES), 0)
    assert [r.comment_volume for r in tables.load(spark, f"{out}/series", live.MOOD_SERIES).collect()] == [1]


def test_frozen_fixture_frees_its_state():
    class Map(dict):
        def getValue(self, k):
            return self[k]

        def updateValue(self, k, v):
            self[k] = v

        def containsKey(self, k):
            return k in self

        def iterator(self):
            return iter(self.items())

    class Handle:
        def __init__(self):
            self.timers = []

        def getMapState(self, *_):
            return Map()

        def registerTimer(self, ms):
            self.timers.append(ms)

    class Clock:
        def getCurrentWatermarkInMs(self):
            return 0

    for job, frame in (
        (state.MoodState(), pd.DataFrame([[1, *[0.5] * 6, 5000]], columns=["minute", *state.EMOTION_COLUMNS, "freeze_ms"])),
        (state.FirstMessages(), pd.DataFrame([["F", 1, pd.Timestamp(0), "m", "s", "a", "k", 5000]], columns=[*state.FIRSTS_NAMES, "message_key", "freeze_ms"])),
    ):
        handle = Handle()
        job.init(handle)
        held = job.minutes if isinstance(job, state.MoodState) else job.seen
        assert len(next(job.handleInputRows(("F",), iter([frame]), Clock()))) and len(held) == 1 and handle.timers == [5000]
        assert next(job.handleExpiredTimer(("F",), Clock(), None)).empty and not held


def test_stream_buffer_and_dedup_across_ticks(spark, rows, tmp_path):
    path = str(tmp_path / "in")
    write_ticks(rows, path, [["one goal", "two goals"], ["ONE goal", "three goals"], ["four goals"]])
    stream = live.landed_stream(spark, path, live.BUFFER, files_per_tick=1)
    live.run_to_end(stream, live.keep_buffer(str(tmp_path / "buf"), 3), str(tmp_path / "cp1"))
    kept = tables.load(spark, str(tmp_path / "buf"), live.BUFFERED)
    assert sorted(r.message for r in kept.collect()) == ["four goals", "three goals", "two goals"]
    out = str(tmp_path / "dedup")
    live.run_to_end(live.without_repeats(stream), lambda b, i: b.write.mode("overwrite").parquet(f"{out}/t={i}"), str(tmp_path / "cp2"))
    assert spark.read.parquet(out).count() == 4
    exact = str(tmp_path / "exact")
    firsts = state.first_messages(stream.join(rows([("F", START)], KICKOFFS), "fixture_id"))
    for _ in range(2):
        live.run_to_end(firsts, lambda b, i: b.write.mode("overwrite").parquet(f"{exact}/t={i}"), str(tmp_path / "cp3"))
    assert sorted(r.message for r in spark.read.parquet(exact).collect()) == ["four goals", "one goal", "three goals", "two goals"]


def test_first_messages_by_key_in_a_few_state_calls():
    calls = []

    class Map(dict):
        def updateValue(self, k, v):
            calls.append("update")
            self[k] = v

        def iterator(self):
            calls.append("iterator")
            return iter(self.items())

        def containsKey(self, k):
            calls.append("contains")
            return k in self

    class Handle:
        def getMapState(self, *_):
            return Map()

        def registerTimer(self, ms):
            pass

    class Clock:
        def getCurrentWatermarkInMs(self):
            return 0

    job = state.FirstMessages()
    job.init(Handle())

    def tick(keys, first):
        data = [["F", first + i, pd.Timestamp(0), k, "s", "a", k, 5000] for i, k in enumerate(keys)]
        frame = pd.DataFrame(data, columns=[*state.FIRSTS_NAMES, "message_key", "freeze_ms"])
        # two chunks of one tick repeat the index
        return next(job.handleInputRows(("F", 0), iter([frame[:2].reset_index(drop=True), frame[2:].reset_index(drop=True)]), Clock()))

    assert list(tick(["a", "b", "a", None], 0)["ingest_seq"]) == [0, 1, 3]
    # the numbers of a tick may start over
    assert list(tick(["c", "b", "d", None, "c"], 0)["ingest_seq"]) == [0, 2]
    assert tick(["d", "a", "c", "b"], 7).empty
    assert len(calls) == 5


def test_posts_with_keys_need_no_message(spark, rows, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_ticks(rows, path, [["one goal", "two goals"], ["ONE goal", "three goals"]])
    stream = live.landed_stream(spark, path, live.BUFFER, files_per_tick=1).withColumn("message_key", state.message_key(F.col("message"))).drop("message")
    firsts = state.first_messages(stream.join(rows([("F", START)], KICKOFFS), "fixture_id"))
    assert "message" not in firsts.columns
    live.run_to_end(firsts, lambda b, i: b.write.mode("overwrite").parquet(f"{out}/t={i}"), str(tmp_path / "cp"))
    assert sorted(r.ingest_seq for r in spark.read.parquet(out).collect()) == [0, 1, 101]


def test_stateful_throttle(spark, rows, tmp_path):
    path = str(tmp_path / "in")
    for tick in ([0, 5, 15], [16, 30], [44, 45]):
        rows([("F", START + timedelta(minutes=m)) for m in tick], "fixture_id STRING, flagged_utc TIMESTAMP").coalesce(1).write.mode("append").parquet(path)
    stream = live.landed_stream(spark, path, "fixture_id STRING, flagged_utc TIMESTAMP", files_per_tick=1)
    out = str(tmp_path / "out")
    for _ in range(2):
        live.run_to_end(state.alerts(stream), lambda b, i: b.write.mode("overwrite").parquet(f"{out}/t={i}"), str(tmp_path / "cp"))
        got = sorted((r.alert_utc - START).seconds // 60 for r in spark.read.parquet(out).collect())
        assert got == [0, 15, 30, 45]


def test_ticks_are_observed_and_counted(spark, rows, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "fixture_id STRING, created_utc TIMESTAMP, kind STRING, source STRING"
    for tick in ([("F", START, "post", "a"), ("F", START, "line", "x")], [("F", START, "post", "b"), ("F", START, "post", "b"), ("G", START, "line", "x")]):
        rows(tick, schema).coalesce(1).write.mode("append").parquet(path)
    counts = live.tick_counts(live.landed_stream(spark, path, schema, files_per_tick=1))
    seen = live.run_to_end(counts, live.upsert_sink(out, live.TICK_COUNTS), str(tmp_path / "cp"), "update")
    assert [s["rows"] for s in seen] == [2, 3] and seen[0]["newest"] == str(START)
    beats = {r.match_id: r for r in live.heartbeats(spark, out, F.lit("2026-06-11").cast("timestamp")).collect()}
    assert beats["F"].reactions_by_source == {"b": 2, "a": 1} and (beats["F"].n_reactions, beats["F"].n_commentary) == (3, 1)
    assert (beats["G"].n_reactions, beats["G"].n_commentary) == (0, 1)


def test_late_rows_go_to_their_own_sink(spark, rows, tmp_path):
    path, base = str(tmp_path / "in"), str(tmp_path)
    board = "fixture_id STRING, state STRING, kickoff_utc TIMESTAMP, post_first_seen TIMESTAMP"
    write_ticks(rows, path, [["one", "two"], ["three"]])
    # the fixture freezes between the ticks
    states = iter(["in", "post"])
    step = live.late_and_live(base, lambda s: rows([("F", next(states), START, START)], board), F.lit(str(START + timedelta(minutes=20))).cast("timestamp"))
    live.run_to_end(live.landed_stream(spark, path, live.BUFFER, files_per_tick=1), step, f"{base}/cp")
    assert sorted(r.message for r in live.routed(spark, base, live.BUFFER, "live").collect()) == ["one", "two"]
    assert [r.message for r in live.routed(spark, base, live.BUFFER, "late").collect()] == ["three"]


def test_split_frozen(rows):
    fixtures = rows([("F", "in", START, None), ("G", "post", START, START)], "fixture_id STRING, state STRING, kickoff_utc TIMESTAMP, post_first_seen TIMESTAMP")
    batch = rows([("F", 1), ("G", 2)], "fixture_id STRING, x INT")
    kept, late = live.split_frozen(batch, fixtures, F.lit(str(START + timedelta(minutes=20))).cast("timestamp"))
    assert [r.x for r in kept.collect()] == [1] and [r.x for r in late.collect()] == [2]


def test_ingest_then_nightly(spark, rows, tmp_path):
    base = str(tmp_path)
    stamp = F.lit("2024-02-01").cast("timestamp")
    fixtures = w.fixtures(spark, SF)
    captured = ingest.capture(w.reactions(spark, SF), w.commentary(spark, SF), fixtures, 0.5, w.LEXICON)
    ingest.store(captured, fixtures, base, stamp)
    ingest.store(captured, fixtures, base, stamp)
    stored = tables.load(spark, f"{base}/match_archive", tables.MATCH_ARCHIVE)
    assert stored.count() == captured.state.count() == stored.select("match_id", "minute").distinct().count()
    dense = stored.groupBy("match_id").agg(F.min("minute").alias("a"), F.max("minute").alias("b"), F.count("*").alias("n"))
    assert dense.filter("a <> 0 OR n <> b + 1").count() == 0
    assert tables.load(spark, f"{base}/run_status", tables.RUN_STATUS).count() == tables.load(spark, f"{base}/match_results", tables.MATCH_RESULTS).count()
    assert nightly.active_threshold(spark, base) == 0.65
    result = nightly.refit(spark, base, as_of=stamp)
    assert result["status"] == "fitted" and nightly.history(spark, base).count() == 1
    assert nightly.active_threshold(spark, base) == result["threshold"]
    assert nightly.refit(spark, str(tmp_path / "none"))["status"] == "skipped: too few minutes"


def test_ingest_of_posts_judges_each_text_once(rows, monkeypatch):
    texts = rows([
        (1, "The GOAL was a fine one"), (2, "alba what a long night"), (3, "nothing to see here"), (3, "Brom is in panic mode"),
        (4, None), (5, "the goal  was a fine one"), (6, "a b"), (7, "never posted match"), (None, "a lost match here")],
        "doc_id BIGINT, message STRING")
    fixtures = rows([("F", START, "Alba", "Brom"), ("G", START, "", None), ("H", START, "Coru", "Dale")],
                    "fixture_id STRING, kickoff_utc TIMESTAMP, home_team STRING, away_team STRING")
    made = [(f, doc, seq, who) for seq, (f, doc, who) in enumerate(
        [(f, doc, who) for f in ("F", "G", "H", None, "X") for doc in (1, 2, 3, 4, 5, 6, None) for who in ("ann", "", None, "some_bot")])]
    posts = rows([(f, START + timedelta(minutes=seq % 9 - 1), "s", who, seq, doc) for f, doc, seq, who in made],
                 "fixture_id STRING, created_utc TIMESTAMP, source STRING, author STRING, ingest_seq BIGINT, doc_id BIGINT")
    lines = rows([("F", 1, "3' Alba: goal! clinical finish")], "fixture_id STRING, seq BIGINT, line STRING")
    scored = []
    emotion_intensities = ingest.emotion_intensities
    monkeypatch.setattr(ingest, "emotion_intensities", lambda df, *a: (scored.append(df), emotion_intensities(df, *a))[1])
    whole = ingest.capture(posts.join(texts, "doc_id"), lines, fixtures, 0.5, w.LEXICON)
    assert not scored
    apart = ingest.capture(posts, lines, fixtures, 0.5, w.LEXICON, texts)
    assert apart.chat.columns == whole.chat.columns
    rows_of = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert rows_of(apart.chat) == rows_of(whole.chat) and apart.chat.count() == 8
    assert {(r.fixture_id, r.team) for r in apart.chat.collect()} >= {("F", "home"), ("F", "away"), ("G", "neither")}
    assert rows_of(apart.state) == rows_of(whole.state) and apart.events.count() == 1
    assert scored[0].count() == scored[0].select("doc_id", "message").distinct().count() < 8


def test_ingest_keeps_more_than_a_window_of_reactions(rows):
    many = 1200
    fixtures = rows([("F", START, "Norhaven", "Sudport")], "fixture_id STRING, kickoff_utc TIMESTAMP, home_team STRING, away_team STRING")
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    texts = rows([(i, f"norhaven wins {letters(i)}") for i in range(many)], "doc_id INT, message STRING")
    posts = rows([("F", START + timedelta(seconds=i % 5), "s", f"u{i % 400}", i, i) for i in range(many)],
                 "fixture_id STRING, created_utc TIMESTAMP, source STRING, author STRING, ingest_seq INT, doc_id INT")
    chat, moods = ingest.gather_posts(posts, texts, fixtures, w.LEXICON)
    assert chat.count() == moods.count() == many
    assert ingest.gather_reactions(posts.join(texts, "doc_id"), fixtures).count() == many


def test_vocabulary_counts_in_batches(rows):
    texts = ["aa bb aa", "aa bb aa bb", None, "", "cc", "bb Aa", "x", "cc dd"] * 3
    docs = rows(list(enumerate(texts)), "doc_id INT, text STRING").repartition(3)
    fitted = textmodel.fit_vocabulary(docs, word_grams(F.col("text")), len(texts), 5)
    total, df = Counter(), Counter()
    for text in texts:
        words = [x for x in (text or "").lower().split() if len(x) > 1]
        grams = words + [" ".join(p) for p in zip(words, words[1:])]
        total.update(grams)
        df.update(set(grams))
    top = sorted((-n, t) for t, n in total.items() if df[t] >= 2)[:5]
    assert {r.term: r.df for r in fitted.collect()} == {t: df[t] for _, t in top}
    plan = fitted._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_training_learns_separable_text(spark, rows, tmp_path):
    data = [(i, ("great lovely win " if i % 2 else "awful terrible loss ") + f"word{i % 7}", "joy" if i % 2 else "anger") for i in range(60)]
    df = rows(data, "id INT, text STRING, y STRING")
    model = training.train(df, "word", 200, 30)
    scored = training.score(model, df)
    assert scored.filter("prediction <> y").count() == 0 and model.classes == ["anger", "joy"]
    record = training.evaluation_record(scored.withColumn("prediction", F.lit("joy")), scored, ["anger", "joy"]).first()
    assert (record.lexicon_accuracy, record.trained_accuracy, record.decision) == (0.5, 1.0, "switched_to_trained")
    training.save(model, str(tmp_path / "model"))
    assert training.cross_validate(df, "word", 200, "id", folds=3, iterations=10).first().cv_accuracy_mean > 0.9


def test_fits_store_counts_and_deal_out_no_grams(spark, rows, monkeypatch):
    dealt, stored = [], []
    folds, written = training.stratified_folds, training.written
    monkeypatch.setattr(training, "stratified_folds", lambda df, *a: (dealt.append(df.columns), folds(df, *a))[1])
    monkeypatch.setattr(training, "written", lambda df: (stored.append(df.columns), written(df))[1])
    data = [(i % 30, ("great win " if i % 2 else "awful loss ") + f"word{i % 7}", "joy" if i % 2 else "anger") for i in range(60)]
    df = rows([*data, (None, None, "joy"), (99, "no label", None)], "id INT, text STRING, y STRING")
    training.train(df, "word", 200, 5)
    assert training.cross_validate(df, "word", 200, "id", folds=3, iterations=10).first().cv_accuracy_mean > 0.9
    assert dealt == [["id", "y", "text"]] and stored == [["y", "tf"], ["y", "fold", "tf"]]


LABELLED = [(i, ("great lovely win " if i % 3 else "awful terrible loss ") + f"word{i % 7} {'é日😀'[i % 3]}", "joy" if i % 3 else "anger" if i % 2 else "calm") for i in range(60)]


def test_char_fit_takes_the_steps_of_sparks_regression(spark, rows, monkeypatch):
    df = rows([*LABELLED, (90, None, "joy"), (91, "", "calm"), (92, "no label", None)], "id INT, text STRING, y STRING")
    prepared = training._prepared(df, "char")
    features, data = training._features(prepared, 5000, prepared, ["y"])
    indexer = training.StringIndexer(inputCol="y", outputCol="label", stringOrderType="alphabetAsc").fit(data)
    weighted, n = training._balanced(indexer.transform(data))
    fitted = training._classifier(n, 12).fit(weighted.select("features", "label", "weight"))
    expected, intercepts = training.model_table(training.TextModel(features, fitted, list(indexer.labels), "char"))
    # neither rows of grams nor a fit that keeps its rows in memory
    for name in ("CountVectorizer", "LogisticRegression.fit", "char_grams"):
        monkeypatch.setattr(f"terrace.plans.training.{name}", None)
    model = training.train(df, "char", 5000, 12)
    got, at = training.model_table(model)
    assert model.classes == list(indexer.labels) and np.allclose(at, intercepts, atol=1e-8)
    known = {term: (idf, weights) for term, idf, weights in expected}
    assert {term for term, _, _ in got} == set(known)
    assert all(np.isclose(idf, known[t][0]) and np.allclose(weights, known[t][1], atol=1e-8) for t, idf, weights in got)
    scored = training.score(model, df)
    assert scored.columns == ["id", "text", "y", "prob_anger", "prob_calm", "prob_joy", "prediction"]
    assert scored.filter("y = 'joy' AND text <> '' AND prediction <> y").count() == 0 and scored.count() == 63


def test_char_folds_share_every_pass(spark, rows, monkeypatch):
    df = rows(LABELLED, "id INT, text STRING, y STRING")
    passes = []
    summed = regression.summed
    monkeypatch.setattr(regression, "summed", lambda *a: (passes.append(1), summed(*a))[1])
    monkeypatch.setattr(training.LogisticRegression, "fit", None)
    assert training.cross_validate(df, "char", 200, "id", folds=4, iterations=6).first().cv_accuracy_mean > 0.6
    assert len(passes) < 2 * 6 + 4


def test_char_counts_against_brute_force_also_of_long_texts(spark, rows, monkeypatch):
    texts = ["The cat  sat", "", None, "a\x00b\x00 é日本日本 😀😀x", "the CAT sat", "x", "zz"]
    found = [[t.lower()[i:i + n] for n in range(2, 6) for i in range(len(t) - n + 1)] for t in (t or "" for t in texts)]
    total, held = Counter(x for f in found for x in f), Counter(x for f in found for x in set(f))
    top = [t for _, t in sorted((-n, t.encode()) for t, n in total.items() if held[t] >= 2)]
    for piece in (1 << 20, 5):
        monkeypatch.setattr(charmodel, "PIECE", piece)
        batches = [pa.RecordBatch.from_pydict({"t": [(t or "").lower() for t in texts]})]
        n, d = Counter(), Counter()
        for b in charmodel._total_batches(iter(batches)):
            for term, x, y in zip(*(c.to_pylist() for c in b.columns)):
                n[term] += x
                d[term] += y
        assert n == total and d == held
        terms = [t.decode() for t in top]
        counts = list(charmodel.Terms(terms).counts([(t or "").lower() for t in texts]))
        assert [{terms[i]: x for i, x in zip(at.tolist(), c.tolist())} for at, c in counts] == [dict(Counter(x for x in f if x in set(terms))) for f in found]
    docs = rows(list(enumerate(texts)), "id INT, text STRING").repartition(3)
    got, df = charmodel.vocabulary(docs, F.col("text"), 9)
    assert got == [t.decode() for t in top[:9]] and df.tolist() == [held[t] for t in got]


def test_gram_counts_shuffle_nothing_where_keys_are_single(rows):
    single = rows([(1, "to be or not to be"), (2, "be"), (3, ""), (4, None), (None, "not not")], "id INT, text STRING")
    grams = word_grams(F.col("text"))

    def plain(pairs):
        found = Counter()
        for i, text in pairs:
            words = [x for x in (text or "").split() if len(x) > 1]
            found.update((i, t) for t in [*words, *(" ".join(p) for p in zip(words, words[1:]))])
        return found

    for frame, shuffled in ((single, False), (single.unionByName(single), True)):
        counts = textmodel.gram_counts(frame, "id", grams)
        assert {(r.id, r.term): r.tf for r in counts.collect()} == plain([tuple(r) for r in frame.collect()])
        assert dict(counts.dtypes)["tf"] == "bigint" and ("Exchange" in counts._jdf.queryExecution().simpleString()) == shuffled
    known = rows([("be",), ("not not",)], "term STRING")
    assert {(r.id, r.term, r.tf) for r in textmodel.gram_counts(single, "id", grams, known).collect()} == {(1, "be", 2), (2, "be", 1), (None, "not not", 1)}


def test_batches_to_python_are_bounded(spark):
    conf = configure(spark).conf
    assert int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000
    assert int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) <= 8 << 20


def test_trained_queries_use_the_declared_terms_and_iterations(spark):
    for task, least in (("emotion", 2000), ("sentiment", 12000)):
        model = job_queries.trained_model(spark, SF, task)
        assert len(model.features.stages[0].vocabulary) > least
        assert model.classifier.getMaxIter() == training.MAX_ITERATIONS
    assert text_queries.FEATURES == training.TASKS["emotion"][1]
    assert contract.queries()["vocabulary"](spark, SF).count() > 2000


def test_char_model_agrees_with_its_join_form(spark, rows):
    data = [(i, ("great lovely win " if i % 2 else "awful terrible loss ") + f"word{i % 7}", "joy" if i % 2 else "anger") for i in range(40)]
    docs = rows(data, "doc_id INT, text STRING, y STRING")
    model = training.train(docs, *training.TASKS["sentiment"])
    terms, intercepts = training.model_table(model)
    table = spark.createDataFrame(terms, "term STRING, idf DOUBLE, weights ARRAY<DOUBLE>")
    counts = textmodel.gram_counts(docs, "doc_id", training.grams("char", F.col("text")), table)
    joined = textmodel.with_probabilities(textmodel.joined_scores(docs, counts, "doc_id", table, model.classes, intercepts), model.classes)
    scored = training.score(model, docs)
    assert scored.filter("prediction <> y").count() == 0
    assert textmodel.parity_gap(scored, joined, "doc_id", ["prob_anger", "prob_joy"]).first().max_gap < 1e-5
    assert {"trained_char_scores", "char_cross_validation", "char_evaluation_record"} <= set(contract.queries())


def test_sparse_features_against_brute_force(rows):
    texts = ["red red blue", "blue green", "", None, "unknown words only", "green " * 300 + "red"]
    docs = rows(list(enumerate(texts)), "id INT, text STRING")
    idf, weights = {"blue": 1.5, "green": 1.1, "red": 2.25}, {"blue": [1.0, -1.0], "green": [0.5, 0.0], "red": [-2.0, 3.0]}
    model = rows([(t, x, weights[t]) for t, x in idf.items()], "term STRING, idf DOUBLE, weights ARRAY<DOUBLE>")
    words = F.split("text", " ")
    values = {}
    for i, text in enumerate(texts):
        raw = {t: text.split(" ").count(t) * x for t, x in idf.items() if text and t in text.split(" ")}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        values.update({(i, t): v / norm for t, v in raw.items()})
    got = {(r.id, r.term): r.value for r in textmodel.tfidf(docs, "id", words, model).collect()}
    assert got.keys() == values.keys() and all(abs(got[k] - values[k]) < 1e-12 for k in got)

    scored = textmodel.linear_scores(docs, "id", words, model, ["a", "b"], [0.25, -0.5])
    for r in scored.collect():
        dots = [sum(v * weights[t][c] for (i, t), v in values.items() if i == r.id) for c in range(2)]
        assert abs(r.score_a - 0.25 - dots[0]) < 1e-12 and abs(r.score_b + 0.5 - dots[1]) < 1e-12
    assert "Exchange" not in plan_of(scored) and scored.count() == len(texts)
    joined = textmodel.joined_scores(docs, textmodel.gram_counts(docs, "id", words, model), "id", model, ["a", "b"], [0.25, -0.5])
    assert textmodel.parity_gap(scored, joined, "id", ["score_a", "score_b"]).first().max_gap < 1e-12
    assert textmodel.tfidf(docs, "id", words, model.limit(0)).count() == 0
    assert {(r.score_a, r.score_b) for r in textmodel.linear_scores(docs, "id", words, model.limit(0), ["a", "b"], [0.25, -0.5]).collect()} == {(0.25, -0.5)}


def test_labelled_text_keeps_documents_without_language(spark, rows, tmp_path):
    rows([(1, "a", "en"), (2, "b", None), (3, "c", "it")], "doc_id LONG, text STRING, lang STRING").write.parquet(f"{tmp_path}/documents.parquet")
    rows([(1, 0, 0), (2, 1, 0), (3, 1, 1)], "doc_id LONG, quality INT, toxic INT").write.parquet(f"{tmp_path}/labels.parquet")
    got = contract.queries()["labelled_text"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.lang, r.y) for r in got) == [(1, "en", "low"), (2, None, "good"), (3, "it", "good")]


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_group_limit_runs_before_the_exchange(spark):
    plan = plan_of(cleaning.newest(w.posts(spark, SF)))
    assert plan.count("WindowGroupLimit") >= 2
    assert "WindowGroupLimit" in plan_of(cleaning.cap_authors(w.posts(spark, SF)))


def test_scan_prunes_columns_and_pushes_filters(spark):
    plan = plan_of(w.posts(spark, SF))
    assert "PushedFilters: [In(event_type" in plan
    assert "html" not in plan_of(w.chat(spark, SF)) and "n_chars" not in plan_of(_with_terms(spark, SF).select("ingest_seq", "message")).split("== Physical Plan ==")[1]


SHAPED = [q for m in ("mood_queries", "reaction_queries", "source_queries", "context_queries", "text_queries") for q in contract.by_module(m)]


@pytest.mark.parametrize("name", SHAPED)
def test_no_cross_joins(spark, name):
    plan = plan_of(contract.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


CHECKED = ["flagged_minutes", "situations", "clean_reactions", "team_tags", "mood_verdicts", "fixture_events", "tfidf", "stream_minutes", "linear_scores", "emotion_intensities_table",
           "term_semi_join", "backfill_matches", "labelled_rows", "old_schema_rows", "ingest_reactions", "ingest_results"]


@pytest.mark.parametrize("name", CHECKED)
def test_registered_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("events", "documents", "labels", "part", "lineitem", "orders", "customer", "nation"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = contract.queries()[name](spark, SF)
    columns = sorted(got.columns)
    picked = ", ".join(f'"{c}"' for c in columns)
    expected = con.sql(f"SELECT {picked} FROM ({contract.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, expected))


def test_contract_shape(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries()) and len(contract.queries()) > 100
    assert contract.entry(spark).columns == ["fixture_id", "minute", "crowd_panic_score", "delta_xg_10min", "arbitrage_index"]
