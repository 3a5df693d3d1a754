"""N-grams, TF-IDF, linear scores, the lexicon/model blend and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrace import workload as w
from terrace.functions.lexicon import panic_score
from terrace.functions.text import char_grams, word_grams
from terrace.operators import mood, textmodel
from terrace.operators.minutes import posts_to_chat
from terrace.plans.training import TASKS
from terrace.registry.base import (
    EMO_SUM, PER_FIXTURE, VIEWS, WORDS, dominant_sql, q6, query, rounded, s6, term_sum,
)
from terrace.schemas import EMOTION_COLUMNS, EMOTIONS

FEATURES = TASKS["emotion"][1]
CLASSES = ["anger", "despair", "joy", "panic", "surprise"]
INTERCEPT = [0.1, -0.2, 0.05, 0.0, -0.1]
TONES = ["negative", "neutral", "positive"]

# Given coefficients: a fixed function of the term, so that both engines agree on them.
def _weight_sql(i: int) -> str:
    return f"((length(term) * {i + 3} + ascii(term)) % {7 + i}) / 5.0 - 0.5"


VIEWS.update({
    "toks": f"SELECT doc_id, regexp_extract_all(lower(text), '{WORDS}{{2,}}') AS ts FROM documents",
    "grams": """SELECT doc_id, unnest(ts) AS term FROM toks UNION ALL
        SELECT doc_id, unnest(list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1])) FROM toks""",
    "tf": "SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL",
    "voc": f"""SELECT term, df, ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1 AS idf FROM (
        SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT {FEATURES})""",
    "feats": "SELECT doc_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS value FROM tf JOIN voc USING (term)",
    "lin": "SELECT doc_id, " + ", ".join(
        f"coalesce(sum(value * ({_weight_sql(i)})), 0) + {b} AS score_{c}" for i, (c, b) in enumerate(zip(CLASSES, INTERCEPT))
    ) + " FROM (SELECT doc_id FROM documents) LEFT JOIN feats USING (doc_id) GROUP BY 1",
    "soft": "SELECT doc_id, " + ", ".join(
        f"exp(score_{c} - m) / ({' + '.join(f'exp(score_{k} - m)' for k in CLASSES)}) AS prob_{c}" for c in CLASSES
    ) + ", CASE " + " ".join(f"WHEN score_{c} = m THEN '{c}'" for c in CLASSES) + " END AS prediction FROM (SELECT *, greatest("
        + ", ".join(f"score_{c}" for c in CLASSES) + ") AS m FROM lin)",
    "blend0": f"SELECT *, {EMO_SUM} AS s FROM emo JOIN soft USING (doc_id)",
    "blend1": "SELECT *, CASE WHEN s > 0 THEN least(0.7, s / (s + 0.6)) ELSE 0 END AS w FROM blend0",
    "blend2": "SELECT doc_id, prob_anger, prob_joy, " + ", ".join(
        f"(1 - w) * {'prob_' + e if e in CLASSES else '0'} + w * CASE WHEN s > 0 THEN emo_{e} / s ELSE 0 END AS emo_{e}" for e in EMOTIONS
    ) + " FROM blend1",
    "blend3": "SELECT doc_id, prob_anger, prob_joy, " + ", ".join(f"{c} / ({EMO_SUM}) AS {c}" for c in EMOTION_COLUMNS) + " FROM blend2",
    "hyb": """SELECT *, tanh(1.2*emo_panic + 1.1*emo_despair + 0.6*emo_anger - (emo_confidence + 0.9*emo_joy) + prob_anger - prob_joy) AS panic FROM blend3""",
    "hmean": "SELECT fixture_id, minute, avg(panic) AS panic, " + ", ".join(f"avg({c}) AS {c}" for c in EMOTION_COLUMNS)
        + ", count(*) AS comment_volume FROM timed JOIN hyb USING (doc_id) GROUP BY ALL",
    "hprof": "SELECT fixture_id, minute, " + ", ".join(
        f"coalesce(last_value({c} IGNORE NULLS) OVER ({PER_FIXTURE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS {c}"
        for c in ["panic", *EMOTION_COLUMNS]) + " FROM cal LEFT JOIN hmean USING (fixture_id, minute)",
    "sp": f"SELECT doc_id, tanh({term_sum('low', w.PANIC)}) AS panic FROM (SELECT doc_id, lower(text) AS low FROM documents)",
    "judged": """SELECT doc_id, lang, CASE WHEN panic > 0.15 THEN 'negative' WHEN panic < -0.15 THEN 'positive' ELSE 'neutral' END AS prediction,
        CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS y
        FROM sp JOIN documents USING (doc_id) JOIN labels USING (doc_id)""",
})


def _docs(spark, sf):
    return w.documents(spark, sf).select("doc_id", "text")


def _counts(spark, sf):
    return textmodel.gram_counts(_docs(spark, sf), "doc_id", word_grams(F.col("text")))


def _vocabulary(spark, sf):
    n = w.table(spark, sf, "documents").agg(F.count(F.lit(1))).scalar()
    return textmodel.fit_vocabulary(_docs(spark, sf), word_grams(F.col("text")), n, FEATURES)


def _model(spark, sf):
    """Fitted vocabulary with given weights."""
    weights = F.array(*[
        F.pmod(F.char_length("term") * (i + 3) + F.ascii("term"), F.lit(7 + i)) / 5.0 - 0.5 for i in range(len(CLASSES))
    ])
    return _vocabulary(spark, sf).select("term", "idf", weights.alias("weights"))


def _scores(spark, sf):
    scores = textmodel.linear_scores(_docs(spark, sf), "doc_id", word_grams(F.col("text")), _model(spark, sf), CLASSES, INTERCEPT)
    return textmodel.with_probabilities(scores, CLASSES)


def _hybrid(spark, sf):
    toned = _scores(spark, sf).withColumns({"sent_negative": F.col("prob_anger"), "sent_positive": F.col("prob_joy")})
    return textmodel.hybrid_scores(w.scored_documents(spark, sf).join(toned, "doc_id"), CLASSES)


@query("word_grams", "SELECT doc_id, term, tf FROM tf")
def word_gram_counts(spark, sf):
    return _counts(spark, sf)


@query("char_grams", """SELECT term, count(*) AS n FROM (SELECT unnest(list_concat(
    """ + ", ".join(
        f"CASE WHEN length(low) >= {n} THEN list_transform(range(1, length(low) - {n} + 2), lambda i: substr(low, i, {n})) ELSE [] END"
        for n in range(2, 6)) + ")) AS term FROM (SELECT lower(text) AS low FROM benchmark)) GROUP BY 1")
def char_gram_counts(spark, sf):
    return (
        w.table(spark, sf, "benchmark").select(F.explode(char_grams(F.col("text"))).alias("term"))
        .groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    )


@query("vocabulary", f"SELECT term, df, {q6('idf')} FROM voc")
def vocabulary(spark, sf):
    return rounded(_vocabulary(spark, sf), "idf")


@query("tfidf", f"SELECT doc_id, term, {q6('value')} FROM feats")
def tfidf(spark, sf):
    features = textmodel.tfidf(_docs(spark, sf), "doc_id", word_grams(F.col("text")), _vocabulary(spark, sf))
    return rounded(features, "value")


@query("linear_scores", f"SELECT doc_id, {q6(*[f'prob_{c}' for c in CLASSES])}, prediction FROM soft")
def linear_scores(spark, sf):
    probabilities = [f"prob_{c}" for c in CLASSES]
    return rounded(_scores(spark, sf), *probabilities).select("doc_id", *probabilities, "prediction")


@query("hybrid_scores", f"SELECT doc_id, {q6(*EMOTION_COLUMNS, 'panic')} FROM hyb")
def hybrid_scores(spark, sf):
    return rounded(_hybrid(spark, sf), *EMOTION_COLUMNS, "panic").select("doc_id", *EMOTION_COLUMNS, "panic")


@query("model_series", f"""SELECT fixture_id, minute, {s6(f'avg(panic) OVER ({PER_FIXTURE} ROWS 4 PRECEDING)')} AS crowd_panic_score,
    {dominant_sql()} AS dominant_emotion, {q6('emo_confidence')} FROM hprof""")
def model_series(spark, sf):
    """The mood series from blended scores: same schema as the lexicon series."""
    timed = posts_to_chat(w.posts(spark, sf), w.fixtures(spark, sf)).join(_hybrid(spark, sf), "doc_id")
    return rounded(mood_from_scores(timed), "crowd_panic_score", "emo_confidence").select(
        "fixture_id", "minute", "crowd_panic_score", "dominant_emotion", "emo_confidence"
    )


def mood_from_scores(scored):
    profile = mood.dense_profile(
        mood.minute_means(scored, [*EMOTION_COLUMNS, "panic"]), [*EMOTION_COLUMNS, "panic"]
    )
    series = mood.rolling_panic(profile, "panic").withColumn("dominant_emotion", mood.dominant_emotion())
    return mood.with_volatility(series).drop("panic")


@query("lexicon_labels", f"SELECT doc_id, {dominant_sql()} AS label FROM emo")
def lexicon_labels(spark, sf):
    return w.scored_documents(spark, sf).select("doc_id", textmodel.lexicon_emotion_label().alias("label"))


def _judged(spark, sf):
    tone = textmodel.lexicon_sentiment_label(F.col("panic"))
    scored = panic_score(w.documents(spark, sf), "text", w.PANIC).select("doc_id", "lang", tone.alias("prediction"))
    truth = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return scored.join(w.table(spark, sf, "labels").select("doc_id", truth.alias("y")), "doc_id")


@query("sentiment_labels", "SELECT doc_id, prediction, y FROM judged")
def sentiment_labels(spark, sf):
    return _judged(spark, sf).select("doc_id", "prediction", "y")


def _f1(c: str) -> str:
    both = f"count(*) FILTER (y = '{c}') + count(*) FILTER (prediction = '{c}')"
    return f"CASE WHEN {both} > 0 THEN 2.0 * count(*) FILTER (y = '{c}' AND prediction = '{c}') / ({both}) ELSE 0 END"


_EVALUATED = f"count(*) AS n, {s6('avg(CASE WHEN y = prediction THEN 1.0 ELSE 0.0 END)')} AS accuracy, {s6('((' + ') + ('.join(_f1(c) for c in TONES) + ')) / 3')} AS macro_f1"


@query("evaluation", f"SELECT {_EVALUATED} FROM judged")
def evaluation(spark, sf):
    return rounded(textmodel.accuracy_and_f1(_judged(spark, sf), TONES), "accuracy", "macro_f1")


@query("evaluation_by_language", f"SELECT lang, {_EVALUATED} FROM judged GROUP BY lang")
def evaluation_by_language(spark, sf):
    return rounded(textmodel.accuracy_and_f1(_judged(spark, sf), TONES, keys=["lang"]), "accuracy", "macro_f1")


@query("distinct_counts", "SELECT count(DISTINCT fixture_id) AS fixtures, (SELECT count(DISTINCT lang) FROM documents) AS languages FROM ev")
def distinct_counts(spark, sf):
    languages = w.table(spark, sf, "documents").agg(F.count_distinct("lang")).scalar()
    return w.events(spark, sf).agg(F.count_distinct("fixture_id").alias("fixtures")).withColumn("languages", languages)


@query("scorer_parity", "SELECT true AS agree")
def scorer_parity(spark, sf):
    """One-pass and built-in lexicon scoring of the same texts."""
    from terrace.functions.lexicon import builtin_intensities

    docs = w.documents(spark, sf)
    gap = textmodel.parity_gap(
        w.scored_documents(spark, sf), builtin_intensities(docs, "text", w.LEXICON), "doc_id", EMOTION_COLUMNS
    )
    return gap.select((F.col("max_gap") < 1e-5).alias("agree"))


@query("stratified_folds", """SELECT quality, count(*) AS n, CAST(least(count(*) % 5, 1) AS BIGINT) AS spread FROM labels GROUP BY 1""")
def stratified_folds(spark, sf):
    folds = textmodel.stratified_folds(w.table(spark, sf, "labels"), "quality", "doc_id")
    sizes = [F.count_if(F.col("fold") == i) for i in range(5)]
    return folds.groupBy("quality").agg(sum(sizes[1:], sizes[0]).alias("n"), (F.greatest(*sizes) - F.least(*sizes)).alias("spread"))
