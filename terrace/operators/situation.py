"""Named match situations: nearest weighted prototype with a softmax confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.numbers import clip, half_even
from terrace.operators.minutes import latest

FEATURES = ("crowd_panic_score", "delta_xg_10min", "emotional_volatility", "arbitrage_index")

# Feature weights, the minute feature last.
WEIGHTS = (1.2, 1.0, 1.0, 1.4, 0.6)
TEMPERATURE = 0.25

# Prototype per situation, in order of precedence on ties.
PROTOTYPES: dict[str, tuple[float, ...]] = {
    "cruise_control": (-0.60, 0.60, 0.15, 0.08, 0.50),
    "balanced_contest": (0.00, 0.35, 0.25, 0.15, 0.50),
    "panic_divergence": (0.65, 0.55, 0.35, 0.65, 0.60),
    "genuine_crisis": (0.70, 0.10, 0.45, 0.20, 0.65),
    "late_drama": (0.35, 0.45, 0.65, 0.35, 0.95),
    "emotional_chaos": (0.15, 0.40, 0.80, 0.30, 0.50),
    "dead_rubber": (-0.05, 0.05, 0.08, 0.05, 0.55),
}

# Per situation the display label, the metrics to show and the reading.
PLAYBOOK: list[tuple[str, str, list[str], str]] = [
    ("panic_divergence", "Panic Divergence", ["arbitrage_index", "crowd_panic_score", "delta_xg_10min"],
     "Crowd panic has decoupled from a stable match - the engine's core arbitrage spot. "
     "Watch the index against the flag threshold."),
    ("genuine_crisis", "Genuine Crisis", ["delta_xg_10min", "rolling_xg", "crowd_panic_score"],
     "The panic is justified: attacking threat has collapsed. Sentiment and pitch agree - "
     "no divergence edge here."),
    ("cruise_control", "Cruise Control", ["delta_xg_10min", "emo_confidence", "comment_volume"],
     "Comfortable, stable match with a calm crowd. Low signal value; watch for complacency "
     "if threat fades."),
    ("balanced_contest", "Balanced Contest", ["rolling_xg", "delta_xg_10min", "crowd_panic_score"],
     "Even match, even mood. The next clear chance likely moves both the crowd and the "
     "market - watch threat accumulation."),
    ("late_drama", "Late Drama", ["emotional_volatility", "arbitrage_index", "minute"],
     "Closing stages with an unstable crowd. Sentiment overshoots are common here but "
     "expire fast - short decision windows."),
    ("emotional_chaos", "Emotional Chaos", ["emotional_volatility", "comment_volume", "crowd_panic_score"],
     "The crowd is reacting to everything; mood flips minute to minute. Distrust "
     "single-minute readings, use rolling values."),
    ("dead_rubber", "Dead Rubber", ["comment_volume", "rolling_xg", "emotional_volatility"],
     "Low threat, low engagement. Thin crowd signal - treat all sentiment-derived metrics "
     "as low-confidence."),
]
DEFAULT_METRICS = ["arbitrage_index", "crowd_panic_score", "delta_xg_10min"]
DEFAULT_READING = "Unrecognised situation - showing core engine metrics."

# Display names of the metrics.
METRIC_LABELS = {
    "arbitrage_index": "Arbitrage Index",
    "crowd_panic_score": "Crowd Panic",
    "delta_xg_10min": "xG Stability",
    "rolling_xg": "Rolling xG",
    "emo_confidence": "Confidence Share",
    "emotional_volatility": "Mood Volatility",
    "comment_volume": "Reactions/min",
    "minute": "Minute",
}


def _number(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(0.0)
    value = F.col(name).try_cast("double")
    return F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(0.0))


def classify(state: DataFrame) -> DataFrame:
    """Add ``situation`` and ``situation_confidence`` to every minute."""
    bounds = {"crowd_panic_score": -1.0}
    features = [clip(_number(state, f), bounds.get(f, 0.0), 1.0) for f in FEATURES]
    features.append(clip(_number(state, "minute") / 95.0, 0.0, 1.4))
    named = state.withColumns({f"_f{i}": f for i, f in enumerate(features)})
    distances = []
    for centre in PROTOTYPES.values():
        parts = [F.pow((F.col(f"_f{i}") - c) * w, F.lit(2.0)) for i, (c, w) in enumerate(zip(centre, WEIGHTS))]
        distances.append(sum(parts[1:], parts[0]))
    measured = named.withColumn("_d", F.array(*distances))
    nearest = F.array_min("_d")
    weight = F.aggregate(
        "_d", F.lit(0.0), lambda total, d: total + F.exp(-(d - nearest) / TEMPERATURE)
    )
    labels = F.array(*[F.lit(name) for name in PROTOTYPES])
    return measured.select(
        *state.columns,
        F.element_at(labels, F.array_position("_d", nearest).cast("int")).alias("situation"),
        half_even(1.0 / weight, 4).alias("situation_confidence"),
    )


def _playbook_column(situation: Column, position: int, otherwise: Column) -> Column:
    chain = None
    for row in PLAYBOOK:
        value = F.array(*[F.lit(m) for m in row[2]]) if position == 2 else F.lit(row[position])
        chain = F.when(situation == row[0], value) if chain is None else chain.when(situation == row[0], value)
    return chain.otherwise(otherwise)


def with_brief(df: DataFrame) -> DataFrame:
    """Add the playbook ``label``, ``metrics`` and ``read``, with defaults for unknown names."""
    name = F.col("situation")
    titled = F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
    default = F.when(titled == "", F.lit("Unknown")).otherwise(titled)
    return df.withColumns({
        "label": _playbook_column(name, 1, default),
        "metrics": _playbook_column(name, 2, F.array(*[F.lit(m) for m in DEFAULT_METRICS])),
        "read": _playbook_column(name, 3, F.lit(DEFAULT_READING)),
    })


def key_metrics(state: DataFrame) -> DataFrame:
    """The latest minute's metrics that matter in its situation, one row each."""
    present = [m for m in METRIC_LABELS if m in state.columns]
    values = F.map_from_arrays(
        F.array(*[F.lit(m) for m in present]), F.array(*[F.col(m).try_cast("double") for m in present])
    )
    labels = F.create_map(*[F.lit(x) for pair in METRIC_LABELS.items() for x in pair])
    rows = (
        with_brief(latest(state))
        .withColumn("_values", values)
        .select("fixture_id", "situation", "_values", F.posexplode("metrics").alias("position", "metric"))
    )
    return rows.select(
        "fixture_id", "situation", "position", "metric",
        F.coalesce(F.try_element_at(labels, F.col("metric")), F.col("metric")).alias("label"),
        F.try_element_at("_values", F.col("metric")).alias("value"),
    ).filter(F.col("value").isNotNull())
