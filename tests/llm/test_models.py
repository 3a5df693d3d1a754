"""Held-out accuracy of the models, edge cases, and the pipeline's stages."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from terrace.llm import language, near_dup, quality, suffix_dedup

WORDS = {"en": "the of and with that tion here", "de": "der die und ich nicht ung schein", "fr": "le la que est dans eau oui"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=240, seed=0):
    rng = random.Random(seed)
    rows = []
    for d in range(n):
        lang = rng.choice(sorted(WORDS))
        words = [rng.choice(WORDS[lang].split()) + rng.choice(["", "", rng.choice(WORDS[lang].split())]) for _ in range(rng.randint(20, 80))]
        poor = d % 6 == 0
        text = "!! ".join(words).upper() if poor else " ".join(words)
        rows.append((d, text, lang, f"src{d % 4}", len(text)))
    return rows


ODD = [(9001, None, None, None, None), (9002, "", "en", "src1", 0), (9003, "123 --- 456", "en", "src1", 11), (None, "the of and", "en", None, 3)]


def test_language_held_out_accuracy(spark, table):
    rows = corpus()
    docs = table(rows + ODD + rows[:1], SCHEMA)
    model = language.fit(docs)
    out = language.identify(docs, model).collect()
    assert len(out) == len(rows) + len(ODD) + 1
    truth = {r[0]: r[2] for r in rows}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out if r.doc_id in truth]) > 0.99
    assert all(0 <= r.score <= 1 for r in out)
    assert {r.doc_id: r.lang_pred for r in out if r.doc_id and r.doc_id > 9000} == {9001: "und", 9002: "und", 9003: "und"}
    held = {r.doc_id: r.h for r in docs.select("doc_id", language.held_out().alias("h")).collect()}
    assert 20 < sum(held.values()) < 80 and held[None] is False


def test_language_probabilities_sum_to_one(table):
    model = language.fit(table(corpus(60), SCHEMA))
    letters = sorted({c for words in WORDS.values() for c in words})
    texts = ["the n" + c for c in letters]
    entropy, _ = model.entropies(texts)
    lead, _ = model.entropies(["the n"])
    # the sum over all next symbols, the unseen one included, is one
    logs = -(entropy * 6 - lead * 5)
    assert np.allclose(np.exp(logs).sum(axis=0) + 0, 1, atol=0.05)


def test_every_language_is_learned(table):
    rows = [(i, f"l{i % 1100:04d}", f"text {i % 1100} of this") for i in range(5500)]
    docs = table(rows, "doc_id long, lang string, text string")
    expected = {r.lang for r in docs.filter(~language.held_out()).select("lang").collect()}
    assert len(expected) > 1000 and language.fit(docs, 2, 1).langs == sorted(expected)


def test_language_of_nothing(spark, table):
    empty = spark.createDataFrame([], SCHEMA)
    assert language.identify(empty, language.fit(empty)).count() == 0
    docs = table([(1, "the", None, "s", 3)], SCHEMA)
    assert language.identify(docs, language.fit(docs)).first().lang_pred == "und"


def test_quality_views_learn(spark, table):
    rows = corpus(300, 2)
    docs = table(rows + ODD + rows[:1], SCHEMA)
    labels = table([(d, 0 if d % 6 == 0 else 1) for d in range(0, 300, 2)] + [(2, None), (None, 1), (0, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    out = {r.doc_id: r for r in quality.judge(docs, model).collect()}
    assert all((out[d].quality_score > 0.5) == (d % 6 != 0) for d, *_ in rows)
    assert all(out[d].accepted for d, *_ in rows if d % 6)
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id % 6 = 0 and doc_id < 300").count() == 0
    unlabelled = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.judge(docs, unlabelled).filter("not accepted").count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.judge(empty, model).count() == 0


def test_metadata_features_do_not_depend_on_the_batch():
    long = "s" * 64
    columns = [pa.array(["ab", "ba", None, long + "x", long + "y"]), pa.array([3, None, 2**40, 0, 1]), pa.array([True, None, False, True, True]), pa.array([None] * 5, pa.string())]
    whole = quality.meta_view(columns)
    rows = np.vstack([quality.meta_view([c.slice(i, 1) for c in columns]) for i in range(5)])
    assert (whole == rows).all()
    words = whole[:, :quality.BUCKETS].argmax(axis=1)
    assert words[0] != words[1] and words[3] != words[4] and words[2] == 0


def test_a_view_that_teaches_wrongly_is_not_heard():
    rng = np.random.default_rng(4)
    y = (rng.random(600) < 0.8).astype(float)
    text = np.column_stack([y + rng.normal(0, 0.4, 600), rng.normal(0, 1, 600)])
    pool_y = (rng.random(400) < 0.8).astype(float)
    pool = np.column_stack([pool_y + rng.normal(0, 0.4, 400), rng.normal(0, 1, 400)])
    for meta, pool_meta in ((rng.normal(0, 1, (600, 2)), rng.normal(0, 1, (400, 2))), (text + rng.normal(0, 0.1, text.shape), 1 - pool)):
        models = [quality.cotrain(text, meta, y, pool, pool_meta, [], rounds) for rounds in (0, 4)]
        guard = np.arange(600) % 5 == 3
        losses = [[quality.log_loss(y[guard], quality.sigmoid(view.logit(x[guard]))) for view, x in ((m.text, text), (m.meta, meta))] for m in models]
        assert all(after <= before for before, after in zip(*losses))
    assert quality.lesson(np.array([0.99, 0.98, 0.5]), 0.5)[0].size == 0
    rows, labels = quality.lesson(np.array([0.99, 0.98, 0.97, 0.01, 0.5]), 0.5)
    assert rows.tolist() == [0, 3] and labels.tolist() == [1, 0]


def test_scores_do_not_depend_on_chunks(table, monkeypatch):
    model = language.fit(table(corpus(60), SCHEMA))
    texts = pa.array([r[1] for r in corpus(20, 3)] + [None, "", "123"])
    whole = [x for _, run in model.runs(texts) for x in model.judge(run)[2].tolist()]
    monkeypatch.setattr(language, "CHUNK_CHARS", 300)
    assert np.allclose(whole, [x for _, run in model.runs(texts) for x in model.judge(run)[2].tolist()])


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """Inputs and outputs of the pipeline's stages over a small corpus."""
    folder = tmp_path_factory.mktemp("sf")
    rows = corpus(200, 7)
    passage = " ".join(random.Random(1).choices(WORDS["en"].split(), k=60))
    rows += [(500 + i, rows[1][1], rows[1][2], "src0", rows[1][4]) for i in range(3)]
    for i in range(3):
        own = " ".join(random.Random(50 + i).choices(WORDS["en"].split(), k=80))
        rows.append((600 + i, f"{own} {passage}", "en", "src0", 1))
    spark.createDataFrame(rows + ODD, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, 0 if d % 6 == 0 else 1) for d in range(200)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, str(folder))
        made.write.parquet(f"{folder}/{name}")
        out[name] = docs, spark.read.parquet(f"{folder}/{name}")
        docs = out[name][1]
    return str(folder), out


def test_stages_filter_and_keep(staged):
    _, out = staged
    before, after = out["quality"]
    assert after.columns == before.columns
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    assert kept >= {d for d in range(200) if d % 6} and not kept & {d for d in range(200) if d % 6 == 0}
    before, after = out["language"]
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    assert kept == {r.doc_id for r in before.select("doc_id").collect()} - {9001, 9002, 9003}
    before, after = out["near_copies"]
    judged = {r.doc_id for r in near_dup.near_duplicates(before, 5, 80).filter("kept").collect()}
    assert {r.doc_id for r in after.select("doc_id").collect()} == judged and not {500, 501, 502} & judged
    before, after = out["repeats"]
    texts = {r.doc_id: (r.text, r.n_chars) for r in after.collect()}
    cut = {r.doc_id: r.kept_text for r in suffix_dedup.dedup(before, 100, True).collect()}
    assert after.columns == before.columns and {k: v[0] for k, v in texts.items()} == cut
    assert 0 < len(texts[601][0]) < 450 < len(texts[600][0]) and texts[601][1] == len(texts[601][0])


def test_run_equals_its_stages(spark, staged):
    folder, out = staged
    digest = lambda df: sorted((r.doc_id or -1, r.start, r.length, r.ids_crc32) for r in df.collect())
    whole, parts = corpus_pipeline.run(spark, folder), out["packing"][1]
    total = lambda df: {(r.doc_id, r.doc_tokens) for r in df.collect()}
    assert total(whole) == total(parts) and sum(r[2] for r in digest(whole)) == sum(r[2] for r in digest(parts))
