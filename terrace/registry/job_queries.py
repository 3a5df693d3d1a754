"""Whole jobs over the benchmark tables: ingest, back-fill, panel parts, training."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace import landed, schemas
from terrace import workload as w
from terrace.operators import attribution, textmodel, threat
from terrace.operators.minutes import posts_to_chat
from terrace.plans import backfill, ingest, nightly, panel, training
from terrace.registry.base import AS_OF, SQL, THRESHOLD, classified, query
from terrace.registry.context_queries import fixture_markets
from terrace.registry.reaction_queries import BLANKS, heartbeats, listed_sources
from terrace.session import shared_dir
from terrace.sources import tables


def _base(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _ingested(spark, sf) -> str:
    """Clean, tag, score, classify and store every fixture; the folder of the tables."""
    base = _base(spark, "ingest")
    fixtures = w.fixtures(spark, sf)
    captured = ingest.capture(w.posts(spark, sf), w.commentary(spark, sf), fixtures, THRESHOLD, w.LEXICON, w.messages(spark, sf))
    ingest.store(captured, fixtures, base, F.lit(AS_OF).cast("timestamp"))
    return base


@query("ingest_job", """SELECT fixture_id AS match_id, greatest(coalesce(max(c.minute), 0), coalesce(max(m.minute), 0)) AS last_minute,
    count(DISTINCT c.ingest_seq) AS reactions FROM fx LEFT JOIN (
      SELECT cleaned.*, minute FROM cleaned JOIN timed USING (ingest_seq)) c USING (fixture_id) LEFT JOIN mev m USING (fixture_id) GROUP BY 1""")
def ingest_job(spark, sf):
    """The last minute and the reactions of every fixture, from the stored tables."""
    base = _ingested(spark, sf)
    archived = tables.load(spark, f"{base}/match_archive", tables.MATCH_ARCHIVE).groupBy("match_id").agg(
        F.max("minute").cast("bigint").alias("last_minute")
    )
    beats = tables.load(spark, f"{base}/run_status", tables.RUN_STATUS).select("match_id", F.col("n_reactions").alias("reactions"))
    return archived.join(beats, "match_id")


@query("ingest_reactions", f"""SELECT fixture_id AS match_id, substr(sha256(trim(d.text, {BLANKS})), 1, 24) AS message_hash, t.minute, t.source, t.team, t.author
    FROM (SELECT ingest_seq FROM cleaned) JOIN tagged t USING (ingest_seq) JOIN documents d ON d.doc_id = t.doc_id
    QUALIFY row_number() OVER (PARTITION BY fixture_id, trim(d.text, {BLANKS}) ORDER BY ingest_seq) = 1""")
def ingest_reactions(spark, sf):
    """The reactions an ingest stored, row by row."""
    stored = tables.load(spark, f"{_ingested(spark, sf)}/reactions", tables.REACTIONS)
    return stored.select("match_id", "message_hash", "minute", "source", "team", "author")


@query("ingest_events", "SELECT fixture_id, seq, minute, team, event_type, xg_value FROM mev")
def ingest_events(spark, sf):
    """The events of an ingest's run table."""
    return spark.read.parquet(f"{_ingested(spark, sf)}/match_events").select("fixture_id", "seq", "minute", "team", "event_type", "xg_value")


@query("ingest_results", """SELECT fixture_id AS match_id, home_team, away_team, score AS final_score, state FROM fx WHERE fixture_id IN (
    SELECT fixture_id FROM mev UNION SELECT t.fixture_id FROM timed t JOIN cleaned USING (ingest_seq))""")
def ingest_results(spark, sf):
    """The result rows of an ingest."""
    stored = tables.load(spark, f"{_ingested(spark, sf)}/match_results", tables.MATCH_RESULTS)
    return stored.select("match_id", "home_team", "away_team", "final_score", "state")


@query("nightly_job", "SELECT 'fitted' AS status, (SELECT count(DISTINCT fixture_id) FROM truth) AS matches, CAST(threshold AS DOUBLE) AS threshold, 1::BIGINT AS records FROM grid ORDER BY grid.log_loss, threshold LIMIT 1")
def nightly_job(spark, sf):
    """Archive the scored state, re-fit on it and read the logged record back."""
    from terrace.operators import archive
    from terrace.registry.base import classified

    base = _base(spark, "nightly")
    stamp = F.lit(AS_OF).cast("timestamp")
    rows = archive.validate_state(classified(spark, sf).withColumn("ingest_seq", F.col("minute")), stamp)
    tables.upsert(rows, f"{base}/match_archive", tables.MATCH_ARCHIVE)
    result = nightly.refit(spark, base, as_of=stamp)
    return nightly.history(spark, base).groupBy("matches", "threshold").agg(F.count(F.lit(1)).alias("records")).select(
        F.lit(result["status"]).alias("status"), "matches", "threshold", "records"
    )


@query("backfill_job", """SELECT fixture_id AS match_id, count(*) AS n FROM (
    SELECT fixture_id, doc_id FROM (SELECT b.*, d.norm, d.text FROM bf b JOIN doc_flags d USING (doc_id) WHERE readable AND author NOT LIKE '%bot'
      QUALIFY row_number() OVER (PARTITION BY fixture_id, norm ORDER BY ingest_seq) = 1)
    QUALIFY row_number() OVER (PARTITION BY fixture_id, author ORDER BY ingest_seq) <= 5) GROUP BY 1""")
def backfill_job(spark, sf):
    posts = w.posts(spark, sf).drop("fixture_id")
    return backfill.backfill(posts, w.fixtures(spark, sf), w.messages(spark, sf)).groupBy("match_id").agg(F.count(F.lit(1)).alias("n"))


def _labelled(spark, sf):
    y = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    docs = w.documents(spark, sf)
    return docs.join(w.table(spark, sf, "labels").select("doc_id", y.alias("y")), "doc_id")


def trained_model(spark, sf, task: str = "emotion"):
    rows = _labelled(spark, sf).filter(F.pmod(F.xxhash64("doc_id"), F.lit(5)) != 0)
    return training.train(rows, *training.TASKS[task])


@query("trained_scores")
def trained_scores(spark, sf):
    """Train on the labelled texts, then score every document with the fitted model."""
    model = trained_model(spark, sf)
    return training.score(model, w.documents(spark, sf)).drop("text")


@query("trained_char_scores")
def trained_char_scores(spark, sf):
    """The character model in the same way."""
    return training.score(trained_model(spark, sf, "sentiment"), w.documents(spark, sf)).drop("text")


@query("trained_parity", "SELECT true AS agree")
def trained_parity(spark, sf):
    """The fitted model's own scoring against the join form on its exported coefficients."""
    model = trained_model(spark, sf)
    rows, intercepts = training.model_table(model)
    table = spark.createDataFrame(rows, "term STRING, idf DOUBLE, weights ARRAY<DOUBLE>")
    docs = w.documents(spark, sf)
    counts = textmodel.gram_counts(docs, "doc_id", training.grams(model.analyzer, F.col("text")), table)
    joined = textmodel.with_probabilities(
        textmodel.joined_scores(docs, counts, "doc_id", table, model.classes, intercepts), model.classes
    )
    columns = [f"prob_{c}" for c in model.classes]
    gap = textmodel.parity_gap(training.score(model, docs), joined, "doc_id", columns)
    return gap.select((F.col("max_gap") < 1e-5).alias("agree"))


@query("cross_validation")
def cross_validation(spark, sf):
    return training.cross_validate(_labelled(spark, sf), *training.TASKS["emotion"], "doc_id")


@query("char_cross_validation")
def char_cross_validation(spark, sf):
    return training.cross_validate(_labelled(spark, sf), *training.TASKS["sentiment"], "doc_id")


def _record(spark, sf, task: str):
    from terrace.functions.lexicon import panic_score

    held = _labelled(spark, sf).filter(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0)
    tone = textmodel.lexicon_sentiment_label(F.col("panic"))
    names = F.create_map(*[F.lit(x) for x in ("negative", "toxic", "positive", "good", "neutral", "poor")])
    lexicon = panic_score(held, "text", w.PANIC).select("y", F.element_at(names, tone).alias("prediction"))
    trained = training.score(trained_model(spark, sf, task), held).select("y", "prediction")
    return training.evaluation_record(lexicon, trained, ["good", "poor", "toxic"])


@query("evaluation_record")
def evaluation_record(spark, sf):
    """Lexicon against trained model on the held-out fifth."""
    return _record(spark, sf, "emotion")


@query("char_evaluation_record")
def char_evaluation_record(spark, sf):
    """Lexicon against the character model on the held-out fifth."""
    return _record(spark, sf, "sentiment")


@query("status_files", "SELECT match_id, last_run_utc, source, live, n_reactions, n_commentary, listed AS reactions_by_source, fetch_ok FROM hb")
def status_files(spark, sf):
    """Heartbeats written as status files and read back with their schema."""
    path = f"{_base(spark, 'status')}/run_status"
    tables.write_status(heartbeats(spark, sf), path)
    return listed_sources(tables.read_status(spark, path, schemas.RUN_STATUS))


@query("run_tables", """SELECT 'raw_commentary' AS name, fixture_id, count(*) AS n FROM lines WHERE seq % 2 = 0 GROUP BY ALL
    UNION ALL SELECT 'match_events', fixture_id, count(*) FROM mev WHERE seq % 2 = 0 GROUP BY ALL""")
def run_tables(spark, sf):
    """Two runs into the same place: only the later one's rows are there."""
    base = _base(spark, "run")
    for run in (1, 0):
        lines = w.commentary(spark, sf).filter(F.pmod("seq", F.lit(2)) == run)
        tables.replace_tables({"raw_commentary": lines, "match_events": threat.parse_commentary(lines)}, base)
    counts = [
        spark.read.parquet(f"{base}/{name}").groupBy("fixture_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "fixture_id", "n")
        for name in ("raw_commentary", "match_events")
    ]
    return counts[0].unionByName(counts[1])


def _detail(spark, sf):
    """All detail payloads of a fixture in one landed frame, as a feed delivers them."""
    kinds = [landed.box_scores, landed.rosters, landed.leaders, landed.key_events]
    rows = [kind(spark, sf).withColumn("payload_order", F.col("payload_order").cast("bigint")) for kind in kinds]
    return panel.fixture_detail(reduce(DataFrame.unionByName, rows))


def _panel(spark, sf):
    fixtures = w.fixtures(spark, sf)
    tagged = attribution.tag_teams(posts_to_chat(w.reactions(spark, sf), fixtures), fixtures)
    return panel.panel(classified(spark, sf), tagged, fixtures, _detail(spark, sf), THRESHOLD, fixture_markets(spark, sf), w.LEXICON)


# The panel's tables are those of the single queries, built as one plan from one landed frame.
for _name, _table, _same in [
    ("panel_conflicts", "conflicts", "conflict_moments"), ("panel_takeaways", "takeaways", "takeaways"),
    ("panel_trigger", "trigger", "overreaction_trigger"), ("panel_underdogs", "underdogs", "underdog_evidence"),
]:
    query(_name)(lambda spark, sf, table=_table: _panel(spark, sf)[table])
    SQL[_name] = SQL[_same]
for _name, _table, _same in [("detail_keepers", "keepers", "keeper_load"), ("detail_performers", "performers", "top_performers")]:
    query(_name)(lambda spark, sf, table=_table: _detail(spark, sf)[table].drop("team_order"))
    SQL[_name] = SQL[_same]
