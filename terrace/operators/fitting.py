"""Outcome labels on the archive and the re-fit of the flag threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HORIZON = 15
THREAT_FLOOR = 0.30
PANIC_FLOOR = 0.4
STEEPNESS = 8.0
MIN_MINUTES = 180
DEFAULT_THRESHOLD = 0.65
THRESHOLDS = [round(0.05 * i, 2) for i in range(1, 20)]


def panicking() -> Column:
    return F.abs(F.col("crowd_panic_score")) > PANIC_FLOOR


def with_forward_threat(corpus: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Rising edges of the rolling xG, and their sum over the next ``horizon`` rows."""
    order = Window.partitionBy("match_id").orderBy("minute")
    rise = F.coalesce(F.greatest(F.col("rolling_xg") - F.lag("rolling_xg").over(order), F.lit(0.0)), F.lit(0.0))
    ahead = order.rowsBetween(1, horizon)
    return corpus.withColumn("arrival", rise).withColumn(
        "forward_threat", F.coalesce(F.sum("arrival").over(ahead), F.lit(0.0))
    )


def corpus_truth(corpus: DataFrame, horizon: int = HORIZON, floor: float = THREAT_FLOOR) -> DataFrame:
    """Label 1.0 where panic was not followed by threat.

    The sum is compared at nine digits: events are worth multiples of 0.01, and
    a sum of exactly the floor must not depend on the order of addition.
    """
    ahead = with_forward_threat(corpus, horizon)
    truth = panicking() & (F.round("forward_threat", 9) < floor)
    return ahead.withColumn("overreaction", truth.cast("double"))


def lookahead_truth(state: DataFrame, events: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Label 1.0 where panic was not followed by a goal or penalty within the horizon.

    Each scoring minute marks the minutes before it, so the look-ahead is an
    equi-join on distinct (fixture, minute) marks instead of a range join.
    """
    minute = F.col("minute")
    marks = (
        events.filter(F.col("event_type").isin("goal", "penalty"))
        .select("fixture_id", "minute").distinct()
        .select("fixture_id", F.explode(F.sequence(minute - horizon, minute - 1)).alias("minute"))
        .distinct()
        .withColumn("_coming", F.lit(True))
    )
    joined = state.join(marks, ["fixture_id", "minute"], "left")
    truth = panicking() & F.col("_coming").isNull()
    return joined.withColumn("overreaction", truth.cast("double")).drop("_coming")


def loss_term(truth: Column, probability: Column) -> Column:
    p = F.greatest(F.least(probability, F.lit(1.0 - 1e-7)), F.lit(1e-7))
    return -(truth * F.ln(p) + (1.0 - truth) * F.ln(1.0 - p))


def log_loss(scored: DataFrame, truth: str, probability: str) -> DataFrame:
    return scored.agg(F.avg(loss_term(F.col(truth), F.col(probability))).alias("log_loss"))


def _losses(steepness: float) -> list[Column]:
    """Mean log-loss per candidate threshold: one aggregate each, all in one pass."""
    return [
        F.avg(loss_term(
            F.col("overreaction"),
            1.0 / (1.0 + F.exp(-steepness * (F.col("arbitrage_index") - t))),
        ))
        for t in THRESHOLDS
    ]


def threshold_grid(labelled: DataFrame, steepness: float = STEEPNESS) -> DataFrame:
    """(threshold, log_loss) for the 19 candidates without multiplying the corpus."""
    names = [f"_l{i}" for i in range(len(THRESHOLDS))]
    sums = labelled.agg(*[c.alias(n) for c, n in zip(_losses(steepness), names)])
    pairs = F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.col(n).alias("log_loss")) for t, n in zip(THRESHOLDS, names)
    ])
    return sums.select(F.explode(pairs).alias("p")).select("p.*")


def best_threshold(grid: DataFrame) -> DataFrame:
    """Lowest loss; the lower threshold wins a tie."""
    best = grid.agg(F.min(F.struct("log_loss", "threshold")).alias("b"))
    return best.select(
        F.coalesce("b.threshold", F.lit(DEFAULT_THRESHOLD)).alias("threshold"),
        F.coalesce("b.log_loss", F.lit(float("inf"))).alias("log_loss"),
    )


def fit_threshold(corpus: DataFrame, current: float = DEFAULT_THRESHOLD, min_minutes: int = MIN_MINUTES) -> DataFrame:
    """One row: fitted or kept threshold, loss, corpus size and status.

    Too few minutes, or labels of only one class, keep the current threshold.
    """
    labelled = corpus_truth(corpus)
    names = [f"_l{i}" for i in range(len(THRESHOLDS))]
    sums = labelled.agg(
        F.count(F.lit(1)).alias("evaluated_minutes"),
        F.coalesce(F.sum("overreaction"), F.lit(0.0)).alias("_positives"),
        F.countDistinct("match_id").alias("matches"),
        *[c.alias(n) for c, n in zip(_losses(STEEPNESS), names)],
    )
    best = F.array_min(F.array(*[
        F.struct(F.col(n).alias("log_loss"), F.lit(t).alias("threshold")) for t, n in zip(THRESHOLDS, names)
    ]))
    enough = F.col("evaluated_minutes") >= min_minutes
    mixed = (F.col("_positives") > 0) & (F.col("_positives") < F.col("evaluated_minutes"))
    fitted = enough & mixed
    return sums.withColumn("_b", best).select(
        F.when(fitted, F.col("_b.threshold")).otherwise(F.lit(current)).alias("threshold"),
        F.when(fitted, F.col("_b.log_loss")).alias("log_loss"),
        "evaluated_minutes", "matches",
        F.when(~enough, "skipped: too few minutes").when(~mixed, "skipped: one outcome class")
        .otherwise("fitted").alias("status"),
    )
