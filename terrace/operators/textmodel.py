"""TF-IDF features and linear scores from tables, and the lexicon/model blend.

This is the form for vocabularies and coefficients that come as tables. They are
bounded by the feature limit, so the tasks hold them: a document becomes one sparse
vector inside its row, and nothing is shuffled. ``joined_scores`` is the same score
by joins, for tables no task can hold.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.numbers import first_max
from terrace.operators.mood import mood_balance, total_intensity
from terrace.schemas import EMOTION_COLUMNS

# Intensity at which the lexicon weight is half, and its cap.
LEXICON_HALF = 0.6
LEXICON_CAP = 0.7


def counted_terms(grams: Column) -> Column:
    """(term, tf) of a row's grams: lengths of the runs of equal grams in their sorted list."""
    def bound(value: Column, change: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), change), F.lit(0))

    def runs(s: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(s) - 1)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return bound(starts, lambda at: F.transform(at, lambda i, k: F.struct(
            F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("bigint").alias("tf"))))

    return bound(F.sort_array(grams), lambda s: F.when(F.size(s) > 0, runs(s)))


def gram_counts(docs: DataFrame, key: str, grams: Column, known: DataFrame | None = None) -> DataFrame:
    """(key, term, tf). A document's repeats combine in its own row.

    Where no two rows share a key, which a pass over the keys alone tells,
    nothing is shuffled; otherwise the counts of their rows are summed. With a
    vocabulary (bounded by its feature limit), unknown terms go in the task.
    """
    terms = docs.select(key, F.explode(counted_terms(grams)).alias("_c")).select(key, "_c.term", "_c.tf")
    if known is not None:
        terms = terms.join(F.broadcast(known.select("term")), "term", "left_semi").select(key, "term", "tf")
    if docs.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty():
        return terms
    return terms.groupBy(key, "term").agg(F.sum("tf").alias("tf"))


def fit_vocabulary(docs: DataFrame, grams: Column, documents: int | Column, max_features: int, min_df: int = 2) -> DataFrame:
    """(term, df, idf) of the most frequent terms; ties go to the smaller term.

    Each batch of rows becomes one row per term, with its total and the number
    of its documents, so only per-term sums are shuffled, never (document, term)
    pairs, and no gram is a row of its own.
    """
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            of = pa.table({"row": pc.list_parent_indices(lists), "term": pc.list_flatten(lists)})
            in_rows = of.group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
            sums = in_rows.group_by("term", use_threads=False).aggregate([("count_all", "sum"), ([], "count_all")])
            yield from sums.select(["term", "count_all_sum", "count_all"]).rename_columns(["term", "n", "d"]).to_batches()

    counted = docs.select(grams.alias("_g")).mapInArrow(per_batch, "term STRING, n BIGINT, d BIGINT")
    per_term = counted.groupBy("term").agg(F.sum("n").alias("total"), F.sum("d").alias("df"))
    top = per_term.filter(F.col("df") >= min_df).orderBy(F.desc("total"), "term").limit(max_features)
    n = documents if isinstance(documents, Column) else F.lit(documents)
    return top.select("term", "df", (F.ln((n + 1) / (F.col("df") + 1)) + 1.0).alias("idf"))


def _constant(values: list, of: str) -> Column:
    """A list as one literal array, folded once while planning."""
    return F.from_json(F.lit(json.dumps(values)), f"ARRAY<{of}>")


def sparse_features(docs: DataFrame, key: str, grams: Column, terms: list[str], idf: list[float]) -> DataFrame:
    """(key, _at, _values, _norm): places in ``terms`` in ascending order, tf x idf, and its length.

    One row per document, also without a known term (empty arrays, length 0) or text.
    """
    model = CountVectorizerModel.from_vocabulary(terms, inputCol="_grams", outputCol="_counts")
    no_terms = F.array().cast("array<string>")
    counted = model.transform(docs.select(key, F.coalesce(grams, no_terms).alias("_grams")))
    sparse = counted.select(key, F.unwrap_udt("_counts").alias("_c")).select(key, "_c.indices", "_c.values")
    scale = _constant(idf, "DOUBLE")
    valued = sparse.select(
        key, F.col("indices").alias("_at"), F.zip_with("indices", "values", lambda i, tf: tf * F.get(scale, i)).alias("_values")
    )
    return valued.withColumn("_norm", F.sqrt(F.aggregate("_values", F.lit(0.0), lambda total, x: total + x * x)))


def tfidf(docs: DataFrame, key: str, grams: Column, vocabulary: DataFrame) -> DataFrame:
    """(key, term, value): L2-normalised tf x idf per document; unknown terms ignored."""
    known = vocabulary.select("term", "idf").orderBy("term").collect()
    if not known:
        return docs.select(key, F.lit("").alias("term"), F.lit(0.0).alias("value")).limit(0)
    terms = [r["term"] for r in known]
    names = _constant(terms, "STRING")
    features = sparse_features(docs, key, grams, terms, [r["idf"] for r in known])
    pairs = F.zip_with("_at", "_values", lambda i, x: F.struct(F.get(names, i).alias("term"), (x / F.col("_norm")).alias("value")))
    return features.select(key, F.explode(pairs).alias("_p")).select(key, "_p.term", "_p.value")


def _products(weights: Column) -> Column:
    return F.zip_with("_at", "_values", lambda at, x: x * F.get(weights, at))


def linear_scores(
    docs: DataFrame, key: str, grams: Column, model: DataFrame, classes: Sequence[str], intercept: Sequence[float]
) -> DataFrame:
    """Class scores per document: dot product over norm, plus intercept.

    ``model`` is (term, idf, weights array in class order). Documents without a
    known term keep the intercept alone.
    """
    known = model.select("term", "idf", "weights").orderBy("term").collect()
    if not known:
        return docs.select(key, *[F.lit(float(b)).alias(f"score_{c}") for c, b in zip(classes, intercept)])
    features = sparse_features(docs, key, grams, [r["term"] for r in known], [r["idf"] for r in known])
    scores = []
    for i, (c, b) in enumerate(zip(classes, intercept)):
        weights = _constant([r["weights"][i] for r in known], "DOUBLE")
        dot = F.aggregate(_products(weights), F.lit(0.0), lambda total, x: total + x)
        scores.append((F.when(F.col("_norm") > 0, dot / F.col("_norm")).otherwise(0.0) + float(b)).alias(f"score_{c}"))
    return features.select(key, *scores)


def joined_scores(
    docs: DataFrame, counts: DataFrame, key: str, model: DataFrame, classes: Sequence[str], intercept: Sequence[float]
) -> DataFrame:
    """``linear_scores`` of counted (key, term, tf) rows by a join and one aggregate."""
    value = F.col("tf") * F.col("idf")
    sums = (
        counts.join(model, "term")
        .groupBy(key)
        .agg(
            F.sqrt(F.sum(value * value)).alias("_norm"),
            *[F.sum(value * F.get("weights", F.lit(i))).alias(f"_dot{i}") for i in range(len(classes))],
        )
    )
    joined = docs.select(key).join(sums, key, "left")
    scores = [
        (F.when(F.col("_norm") > 0, F.col(f"_dot{i}") / F.col("_norm")).otherwise(0.0) + float(b)).alias(f"score_{c}")
        for i, (c, b) in enumerate(zip(classes, intercept))
    ]
    return joined.select(key, *scores)


def with_probabilities(scored: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Stabilised softmax ``prob_*`` and the first-maximum ``prediction``."""
    scores = F.array(*[F.col(f"score_{c}") for c in classes])
    exps = {f"_e_{c}": F.exp(F.col(f"score_{c}") - F.col("_top")) for c in classes}
    ready = scored.withColumn("_top", F.array_max(scores)).withColumns(exps)
    total = sum((F.col(f"_e_{c}") for c in classes), F.lit(0.0))
    labels = F.array(*[F.lit(c) for c in classes])
    return ready.select(
        *scored.columns, *[(F.col(f"_e_{c}") / total).alias(f"prob_{c}") for c in classes],
        F.element_at(labels, first_max(scores).cast("int")).alias("prediction"),
    )


def hybrid_scores(scored: DataFrame, emotion_classes: Sequence[str], sentiment: bool = True) -> DataFrame:
    """Blend lexicon and model shares, then the panic of each message.

    Input has the lexicon intensities in ``emo_*``, the emotion model's
    ``prob_*`` and, with ``sentiment``, ``sent_negative`` / ``sent_positive``.
    The lexicon weighs more the harder it fired; emotions the model does not
    know start at 0.
    """
    strength = F.col("_strength")
    weight = F.when(strength > 0, F.least(F.lit(LEXICON_CAP), strength / (strength + LEXICON_HALF))).otherwise(0.0)
    base = scored.withColumn("_strength", total_intensity()).withColumn("_w", weight)
    blend = {}
    for column in EMOTION_COLUMNS:
        name = column.removeprefix("emo_")
        model = F.col(f"prob_{name}") if name in emotion_classes else F.lit(0.0)
        lexicon = F.when(strength > 0, F.col(column) / strength).otherwise(0.0)
        blend[column] = (1.0 - F.col("_w")) * model + F.col("_w") * lexicon
    mixed = base.withColumns(blend).withColumn("_t", total_intensity())
    shares = mixed.withColumns({
        c: F.when(F.col("_t") > 0, F.col(c) / F.col("_t")).otherwise(0.0) for c in EMOTION_COLUMNS
    })
    tone = F.col("sent_negative") - F.col("sent_positive") if sentiment else F.lit(0.0)
    return shares.withColumn("panic", F.tanh(mood_balance() + tone)).drop("_strength", "_w", "_t")


def lexicon_emotion_label() -> Column:
    """Label of the strongest intensity, ``neutral`` when silent."""
    from terrace.operators.mood import dominant_emotion

    return dominant_emotion()


def lexicon_sentiment_label(panic: Column, band: float = 0.15) -> Column:
    return F.when(panic > band, "negative").when(panic < -band, "positive").otherwise("neutral")


def accuracy_and_f1(
    predicted: DataFrame, classes: Sequence[str], truth: str = "y", guess: str = "prediction", keys: Sequence[str] = ()
) -> DataFrame:
    """Accuracy and macro F1 over a fixed class list, in one pass; optional grouping keys."""
    hit = (F.col(truth) == F.col(guess)).cast("double")
    aggregates = [F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy")]
    f1 = []
    for i, c in enumerate(classes):
        right = (F.col(truth) == c) & (F.col(guess) == c)
        named = (F.col(truth) == c).cast("int") + (F.col(guess) == c).cast("int")
        aggregates += [F.sum(right.cast("int")).alias(f"_tp{i}"), F.sum(named).alias(f"_all{i}")]
        f1.append(F.when(F.col(f"_all{i}") > 0, 2.0 * F.col(f"_tp{i}") / F.col(f"_all{i}")).otherwise(0.0))
    return predicted.groupBy(*keys).agg(*aggregates).select(
        *keys, "n", "accuracy", (sum(f1, F.lit(0.0)) / float(len(f1))).alias("macro_f1")
    )


def parity_gap(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Largest absolute difference between two scorings of the same rows."""
    other = right.select(key, *[F.col(c).alias(f"_r_{c}") for c in columns])
    gaps = [F.abs(F.col(c) - F.col(f"_r_{c}")) for c in columns]
    return left.join(other, key).agg(F.max(F.greatest(*gaps) if len(gaps) > 1 else gaps[0]).alias("max_gap"))


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42, salt: int = 256) -> DataFrame:
    """Add ``fold``: the folds of a class differ by one row at the most.

    A class may hold most of the rows, so its rows are numbered inside ``salt``
    hash buckets, after the rows of the buckets before (``salt`` counts a class).
    """
    mixed = F.xxhash64(F.lit(seed), F.col(key))
    placed = df.withColumn("_mixed", mixed).withColumn("_bucket", F.pmod("_mixed", F.lit(salt)))
    before = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col(label).alias("_label"), F.col("_bucket").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    order = Window.partitionBy(label, "_bucket").orderBy("_mixed", key)
    numbered = placed.withColumn("_at", F.row_number().over(order))
    joined = numbered.join(starts, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_bucket") == F.col("_of")))
    return joined.select(*df.columns, F.pmod(F.col("_start") + F.col("_at") - 1, F.lit(folds)).cast("int").alias("fold"))
