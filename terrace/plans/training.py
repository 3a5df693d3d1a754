"""Training of the text models on ``pyspark.ml``, cross-validation and promotion.

Scoring with a fitted model is row-local: a hash-map vocabulary, a vector
product and a softmax inside the task, with no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import (
    IDF, CountVectorizer, CountVectorizerModel, ElementwiseProduct, IndexToString, Normalizer, StringIndexer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.text import char_grams, word_grams
from terrace.operators import charmodel, regression
from terrace.operators.textmodel import accuracy_and_f1, stratified_folds
from terrace.session import written

ACCURACY_BAR = 0.80
STRENGTH = 8.0
MAX_ITERATIONS = 200

# Analyzer, vocabulary size and model per task.
TASKS = {"emotion": ("word", 12000), "sentiment": ("char", 20000)}


@dataclass
class TextModel:
    """A fitted feature pipeline and classifier with its class names."""

    features: PipelineModel
    classifier: object
    classes: list[str]
    analyzer: str


def grams(analyzer: str, text: Column) -> Column:
    return word_grams(text) if analyzer == "word" else char_grams(text)


def _features(train: DataFrame, vocabulary: int, placed: DataFrame, keep: list[str]) -> tuple[PipelineModel, DataFrame]:
    """Counts, smoothed idf (the ML idf plus one) and L2 norm, and the ``features`` of ``placed`` beside its ``keep`` columns.

    ``placed`` has the rows of ``train``. Its grams are cut once, for counts that
    are stored without them; all later passes read those.
    """
    vectorizer = CountVectorizer(inputCol="grams", outputCol="tf", minDF=2, vocabSize=vocabulary).fit(train)
    counted = written(vectorizer.transform(placed).select(*keep, "tf"))
    idf = IDF(inputCol="tf", outputCol="_idf").fit(counted)
    scale, norm = _scaled(idf.idf.toArray() + 1.0)
    return PipelineModel(stages=[vectorizer, scale, norm]), norm.transform(scale.transform(counted)).select(*keep, "features")


def _scaled(idf: np.ndarray) -> tuple[ElementwiseProduct, Normalizer]:
    scale = ElementwiseProduct(inputCol="tf", outputCol="_w", scalingVec=Vectors.dense(idf))
    return scale, Normalizer(inputCol="_w", outputCol="features", p=2.0)


def _classifier(rows: int, iterations: int) -> LogisticRegression:
    """Multinomial regression whose penalty equals strength C on balanced weights."""
    return LogisticRegression(
        featuresCol="features", labelCol="label", weightCol="weight", family="multinomial",
        regParam=1.0 / (STRENGTH * rows), elasticNetParam=0.0, standardization=False, maxIter=iterations,
    )


def _prepared(train: DataFrame, analyzer: str) -> DataFrame:
    return train.filter(F.col("y").isNotNull()).withColumn("grams", grams(analyzer, F.coalesce("text", F.lit(""))))


def _balanced(indexed: DataFrame) -> tuple[DataFrame, int]:
    """Weight each class by rows / (classes x class rows); the class table is tiny."""
    sizes = indexed.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()
    rows = sum(r["n"] for r in sizes)
    weights = F.create_map(*[F.lit(x) for r in sizes for x in (r["label"], rows / (len(sizes) * r["n"]))])
    return indexed.withColumn("weight", F.element_at(weights, F.col("label"))), rows


def _char_counts(texts: DataFrame, vocabulary: int, placed: DataFrame, keep: list[str]) -> tuple[list[str], regression.Labelled]:
    """The character terms of labelled ``texts``, and the stored counts of ``placed``, which has the same rows."""
    terms, df = charmodel.vocabulary(texts, F.col("text"), vocabulary)
    idf = np.log((texts.count() + 1.0) / (df + 1.0)) + 1.0
    stored = written(charmodel.counted(placed, "text", keep, charmodel.Terms(terms), idf))
    by = [c for c in keep if c != "y"]
    sizes = stored.groupBy("y", *by).agg(F.count(F.lit(1)).alias("n")).collect()
    labels = {y: i for i, y in enumerate(sorted({r["y"] for r in sizes}))}
    table = np.zeros((max([r["fold"] for r in sizes] if by else [0]) + 1, len(labels)))
    for r in sizes:
        table[r["fold"] if by else 0, labels[r["y"]]] = r["n"]
    return terms, regression.Labelled(stored, labels, table, idf)


def _train_char(rows: DataFrame, vocabulary: int, iterations: int) -> TextModel:
    """As ``train``; grams are never strings of a row, and no pass keeps rows in memory."""
    texts = rows.filter(F.col("y").isNotNull()).withColumn("y", F.col("y").cast("string"))
    terms, data = _char_counts(texts, vocabulary, texts, ["y"])
    fit = regression.fits(data, [None], STRENGTH, iterations)[0]
    context = rows.sparkSession.sparkContext
    classes = len(data.labels)
    matrix = DenseMatrix(classes, len(terms), fit.coefficients.reshape(-1), isTransposed=True)
    made = context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        "char-model", _py2java(context, matrix), _py2java(context, Vectors.dense(fit.intercepts)), classes, True)
    model = _classifier(int(data.sizes.sum()), iterations)._copyValues(LogisticRegressionModel(made))
    vectorizer = CountVectorizerModel.from_vocabulary(terms, inputCol="grams", outputCol="tf")
    return TextModel(PipelineModel(stages=[vectorizer, *_scaled(data.idf)]), model, list(data.labels), "char")


def train(rows: DataFrame, analyzer: str, vocabulary: int, iterations: int = MAX_ITERATIONS) -> TextModel:
    """Fit on (text, y)."""
    if analyzer == "char":
        return _train_char(rows, vocabulary, iterations)
    prepared = _prepared(rows, analyzer)
    features, data = _features(prepared, vocabulary, prepared, ["y"])
    indexer = StringIndexer(inputCol="y", outputCol="label", stringOrderType="alphabetAsc").fit(data)
    weighted, n = _balanced(indexer.transform(data))
    model = _classifier(n, iterations).fit(weighted.select("features", "label", "weight"))
    return TextModel(features, model, list(indexer.labels), analyzer)


def _score_char(model: TextModel, docs: DataFrame, text: str) -> DataFrame:
    """As ``score``: a text is one pass over its characters, its grams are no list."""
    terms = charmodel.Terms(model.features.stages[0].vocabulary)
    idf = model.features.stages[1].getScalingVec().toArray()
    # as stored by the model: rows are terms
    weights = np.ascontiguousarray(model.classifier.coefficientMatrix.toArray().T)
    intercepts = model.classifier.interceptVector.toArray()

    @F.arrow_udf("array<double>")
    def probabilities(texts: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), len(intercepts)))
        for i, (at, n) in enumerate(terms.counts(texts.to_pylist())):
            value = n * idf[at]
            out[i] = value @ weights[at] / (np.sqrt(value @ value) or 1.0) + intercepts
        top = out.max(axis=1, keepdims=True)
        share = np.where(np.isinf(top), np.isinf(out), np.exp(out - np.where(np.isinf(top), 0.0, top)))
        return pa.array(list(share / share.sum(axis=1, keepdims=True)), pa.list_(pa.float64()))

    names = F.array(*[F.lit(c) for c in model.classes])
    most = F.array_position("_p", F.array_max("_p")).cast("int")
    return docs.withColumn("_p", probabilities(charmodel.lowered(F.col(text)))).select(
        *docs.columns, *[F.get("_p", F.lit(i)).alias(f"prob_{c}") for i, c in enumerate(model.classes)],
        F.element_at(names, most).alias("prediction"),
    )


def score(model: TextModel, docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``prob_*`` per class and ``prediction``; docs keep their columns."""
    if model.analyzer == "char":
        return _score_char(model, docs, text)
    prepared = docs.withColumn("grams", grams(model.analyzer, F.coalesce(F.col(text), F.lit(""))))
    scored = model.classifier.transform(model.features.transform(prepared))
    named = IndexToString(inputCol="prediction", outputCol="_label", labels=model.classes).transform(scored)
    split = named.withColumn("_p", vector_to_array("probability"))
    return split.select(
        *docs.columns, *[F.get("_p", F.lit(i)).alias(f"prob_{c}") for i, c in enumerate(model.classes)],
        F.col("_label").alias("prediction"),
    )


def model_table(model: TextModel) -> tuple[list[tuple[str, float, list[float]]], list[float]]:
    """Vocabulary rows (term, idf, weights by class) and intercepts, bounded by the vocabulary size."""
    vectorizer, scale = model.features.stages[0], model.features.stages[1]
    idf = scale.getScalingVec().toArray()
    coefficients = model.classifier.coefficientMatrix.toArray()
    rows = [
        (term, float(idf[i]), [float(x) for x in coefficients[:, i]]) for i, term in enumerate(vectorizer.vocabulary)
    ]
    return rows, [float(b) for b in model.classifier.interceptVector.toArray()]


def cross_validate(rows: DataFrame, analyzer: str, vocabulary: int, key: str, folds: int = 5, iterations: int = MAX_ITERATIONS) -> DataFrame:
    """Stratified k-fold accuracy (mean, deviation) and macro F1 on fixed features.

    One fit per fold, with the penalty and class weights of its own rows; all held-out predictions are measured in one aggregate.
    Character fits share every pass over the stored counts.
    """
    texts = rows.filter(F.col("y").isNotNull()).select(key, "y", "text")
    if analyzer == "char":
        texts = texts.withColumn("y", F.col("y").cast("string"))
        _, data = _char_counts(texts, vocabulary, stratified_folds(texts, "y", key, folds), ["y", "fold"])
        models = regression.fits(data, list(range(len(data.sizes))), STRENGTH, iterations)
        return _cross_measures(regression.guesses(data, models), len(data.labels))
    # the folds deal out texts; grams are cut behind that shuffle, as they hold many times as many bytes
    placed = _prepared(stratified_folds(texts, "y", key, folds), analyzer)
    _, counted = _features(_prepared(texts, analyzer), vocabulary, placed, ["y", "fold"])
    indexer = StringIndexer(inputCol="y", outputCol="label", stringOrderType="alphabetAsc").fit(counted)
    data = indexer.transform(counted).select("features", "label", "fold")
    guesses = None
    for fold in range(folds):
        weighted, n = _balanced(data.filter(F.col("fold") != fold))
        model = _classifier(n, iterations).fit(weighted)
        part = model.transform(data.filter(F.col("fold") == fold)).select("fold", "label", "prediction")
        guesses = part if guesses is None else guesses.unionByName(part)
    return _cross_measures(guesses, len(indexer.labels))


def _cross_measures(guesses: DataFrame, classes: int) -> DataFrame:
    labels = [float(i) for i in range(classes)]
    measured = accuracy_and_f1(guesses, labels, truth="label", keys=["fold"])
    return measured.agg(
        F.round(F.avg("accuracy"), 4).alias("cv_accuracy_mean"),
        F.round(F.stddev_pop("accuracy"), 4).alias("cv_accuracy_std"),
        F.round(F.avg("macro_f1"), 4).alias("cv_macro_f1_mean"),
    )


def evaluation_record(lexicon: DataFrame, trained: DataFrame, classes: list[str], bar: float = ACCURACY_BAR) -> DataFrame:
    """One row comparing both scorers on the same test rows, and the decision."""
    def measured(df: DataFrame, prefix: str) -> DataFrame:
        return accuracy_and_f1(df, classes).select(
            F.lit(1).alias("_one"), F.col("n").alias(f"{prefix}_rows"),
            F.col("accuracy").alias(f"{prefix}_accuracy"), F.col("macro_f1").alias(f"{prefix}_macro_f1"),
        )

    both = measured(lexicon, "lexicon").join(measured(trained, "trained"), "_one").drop("_one")
    return both.withColumn(
        "decision", F.when(F.col("lexicon_accuracy") < bar, "switched_to_trained").otherwise("kept_lexicon")
    )


def save(model: TextModel, path: str) -> None:
    model.features.write().overwrite().save(f"{path}/features")
    model.classifier.write().overwrite().save(f"{path}/classifier")
