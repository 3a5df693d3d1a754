"""Nightly job: re-fit the flag threshold on the archive and log the fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace import schemas
from terrace.operators import fitting
from terrace.sources import tables


def refit(
    spark: SparkSession, base: str, current: float = fitting.DEFAULT_THRESHOLD,
    min_minutes: int = fitting.MIN_MINUTES, as_of: Column | None = None,
) -> dict[str, object]:
    """Fit, append a history record when fitted, return the single result row."""
    corpus = tables.load(spark, f"{base}/match_archive", tables.MATCH_ARCHIVE)
    result = fitting.fit_threshold(corpus, current, min_minutes).first().asDict()
    if result["status"] == "fitted":
        stamp = F.current_timestamp() if as_of is None else as_of
        row = spark.createDataFrame(
            [(round(result["log_loss"], 6), result["threshold"], result["evaluated_minutes"], result["matches"])],
            "log_loss DOUBLE, threshold DOUBLE, evaluated_minutes BIGINT, matches BIGINT",
        )
        record = row.select(stamp.alias("timestamp"), "*", F.lit("match_archive").alias("source"))
        tables.append_rows(record, f"{base}/fit_history")
    return result


def history(spark: SparkSession, base: str) -> DataFrame:
    return tables.scan(spark, f"{base}/fit_history", schemas.FIT_HISTORY)


def active_threshold(spark: SparkSession, base: str) -> float:
    """Threshold of the latest fit, or the default."""
    last = history(spark, base).agg(F.max_by("threshold", "timestamp").alias("t")).first()["t"]
    return fitting.DEFAULT_THRESHOLD if last is None else last
