"""Keyed state of the live jobs: mood by minute, first messages, alert gaps.

Each processor holds what one fixture needs until it freezes, in state that an
event-time timer frees; a tick reads and writes the state of the fixtures it
touches and nothing of earlier ticks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from terrace.functions.text import normalised
from terrace.operators.alerts import GAP_MINUTES
from terrace.operators.health import GRACE_MINUTES, MATCH_MINUTES
from terrace.operators.minutes import LEAD_IN_MINUTES
from terrace.operators.mood import MOOD_WINDOW
from terrace.schemas import EMOTION_COLUMNS, EMOTIONS

LATENESS = "15 minutes"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Message keys of a fixture are spread over this many groups, so that a busy one is no single task. A call
# handles its rows as columns, so calls cost far more than rows, and there is one for each group and tick.
KEY_GROUPS = 2

SERIES = (
    "fixture_id STRING, minute BIGINT, crowd_panic_score DOUBLE, emo_panic DOUBLE, emo_anger DOUBLE, emo_joy DOUBLE, "
    "emo_confidence DOUBLE, emo_despair DOUBLE, emo_surprise DOUBLE, comment_volume BIGINT, dominant_emotion STRING, "
    "emotional_volatility DOUBLE"
)
SERIES_NAMES = [part.split()[0] for part in SERIES.split(", ")]
FIRSTS = "fixture_id STRING, ingest_seq BIGINT, created_utc TIMESTAMP, message STRING, source STRING, author STRING"
FIRSTS_NAMES = [part.split()[0] for part in FIRSTS.split(", ")]
ALERTS = "fixture_id STRING, alert_utc TIMESTAMP"


def keeps_state(spark: SparkSession) -> SparkSession:
    """Processors need the state store that holds several states of a key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


def freeze_ms(kickoff: Column) -> Column:
    """When nothing of a fixture can change any more."""
    return F.unix_millis(kickoff) + F.lit((MATCH_MINUTES + GRACE_MINUTES + LEAD_IN_MINUTES) * 60_000)


def _moments(values: pd.Series) -> list[int]:
    return values.astype("datetime64[us]").astype("int64").tolist()


def series_of(minutes: dict[int, tuple]) -> dict[int, tuple]:
    """The dense series (one tuple a minute) from sums of shares and counts of the minutes that have posts."""
    if not minutes:
        return {}
    last = max(minutes)
    shares, volume = np.zeros((last + 1, len(EMOTION_COLUMNS))), np.zeros(last + 1, np.int64)
    held, n_held = np.zeros(len(EMOTION_COLUMNS)), 0
    for m in range(last + 1):
        if m in minutes:
            *sums, n_held = minutes[m]
            held = np.array(sums) / n_held
        shares[m], volume[m] = held, n_held
    panic, anger, joy, confidence, despair, _ = shares.T
    scores = np.tanh(2.0 * (1.2 * panic + 1.1 * despair + 0.6 * anger - (confidence + 0.9 * joy)))
    step = np.zeros(last + 1)
    step[1:] = np.abs(np.diff(shares, axis=0)).sum(axis=1) / 2
    out = {}
    for m in range(last + 1):
        window = slice(max(0, m - MOOD_WINDOW + 1), m + 1)
        top = int(shares[m].argmax())
        out[m] = (
            float(np.clip(scores[window].mean(), -1, 1)), *map(float, shares[m]), int(volume[m]),
            EMOTIONS[top] if shares[m, top] > 0 else "neutral", float(np.clip(step[window].mean(), 0, 1)),
        )
    return out


class MoodState(StatefulProcessor):
    """Sums of a fixture's minutes; emits the rows of its series that a tick changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        sums = ", ".join(f"{c} DOUBLE" for c in EMOTION_COLUMNS)
        self.minutes = handle.getMapState("minutes", "minute BIGINT", f"{sums}, n BIGINT")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = {k[0]: tuple(v) for k, v in self.minutes.iterator()}
        after = dict(before)
        freeze = None
        for batch in rows:
            sums = batch.groupby("minute")[EMOTION_COLUMNS].sum()
            counts = batch.groupby("minute").size()
            for minute, values in zip(sums.index, sums.to_numpy(), strict=True):
                old = after.get(int(minute), (0.0,) * len(EMOTION_COLUMNS) + (0,))
                after[int(minute)] = (*(float(a + b) for a, b in zip(old, values)), int(old[-1] + counts[minute]))
            freeze = int(batch["freeze_ms"].iloc[0])
        for minute, value in after.items():
            if before.get(minute) != value:
                self.minutes.updateValue((minute,), value)
        if freeze is not None and freeze > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(freeze)
        old, new = series_of(before), series_of(after)
        changed = [(key[0], m, *row) for m, row in new.items() if old.get(m) != row]
        yield pd.DataFrame(changed, columns=SERIES_NAMES)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.minutes.clear()
        yield pd.DataFrame(columns=SERIES_NAMES)

    def close(self) -> None:
        pass


class FirstMessages(StatefulProcessor):
    """Keys of the messages seen so far; lets the first of each through, in ingestion order.

    The new keys of a tick are one entry, so a call reads and writes state a
    few times however many messages it gets.
    """

    def __init__(self, names: list[str] | None = None):
        self.names = names or FIRSTS_NAMES

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "entry BIGINT", "message_keys STRING")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tick = pd.concat(list(rows)).sort_values("ingest_seq", kind="stable").drop_duplicates("message_key")
        entries = [value[0] for _, value in self.seen.iterator()]
        known = {k for keys in entries for k in keys.split(",")}
        # a message without text has no key; digests are never empty
        keys = tick["message_key"].fillna("")
        new = ~keys.isin(known)
        kept = tick[new]
        if len(kept):
            self.seen.updateValue((len(entries),), (",".join(keys[new]),))
        freeze = int(tick["freeze_ms"].iloc[0])
        if freeze > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(freeze)
        yield kept[self.names]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield pd.DataFrame(columns=self.names)

    def close(self) -> None:
        pass


class AlertGap(StatefulProcessor):
    """The last alert of a fixture, until its gap is over."""

    def __init__(self, gap_minutes: int = GAP_MINUTES):
        self.gap = gap_minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last_us BIGINT")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        last = held[0] if held else None
        kept = []
        for at in sorted({t for batch in rows for t in _moments(batch["flagged_utc"])}):
            if last is None or at - last >= self.gap:
                kept.append(at)
                last = at
        if kept:
            self.last.update((last,))
            self.handle.registerTimer(-(-(last + self.gap) // 1000))
        yield pd.DataFrame({"fixture_id": [key[0]] * len(kept), "alert_utc": pd.to_datetime(pd.Series(kept, dtype="int64"), unit="us")})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a later alert has its own timer
        if self.last.exists() and self.last.get()[0] + self.gap <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.last.clear()
        yield pd.DataFrame({"fixture_id": pd.Series(dtype="object"), "alert_utc": pd.Series(dtype="datetime64[us]")})

    def close(self) -> None:
        pass


def mood_changes(shared: DataFrame) -> DataFrame:
    """Changed rows of the mood series (``SERIES``) from a stream of chat rows with shares.

    ``shared`` is (fixture_id, minute, created_utc, kickoff_utc, emo_*).
    """
    keeps_state(shared.sparkSession)
    rows = shared.withWatermark("created_utc", LATENESS).select(
        "fixture_id", "minute", "created_utc", *EMOTION_COLUMNS, freeze_ms(F.col("kickoff_utc")).alias("freeze_ms"))
    return rows.groupBy("fixture_id").transformWithStateInPandas(MoodState(), SERIES, "Update", "EventTime")


def message_key(message: Column) -> Column:
    """Equal for messages that read alike."""
    return F.sha2(normalised(message), 256)


def first_messages(posts: DataFrame) -> DataFrame:
    """The first ingested of all messages of a fixture that normalise to the same text, over all ticks.

    ``posts`` is (``FIRSTS``, kickoff_utc). Exact until the fixture freezes; then
    its keys go, and ``late_and_live`` keeps later rows away. Posts that carry the
    ``message_key`` of their text need no message, and none comes back.
    """
    keeps_state(posts.sparkSession)
    keyed = "message_key" in posts.columns
    key = F.col("message_key") if keyed else message_key(F.col("message"))
    names = [c for c in FIRSTS_NAMES if not (keyed and c == "message")]
    rows = posts.withWatermark("created_utc", LATENESS).select(
        *names, key.alias("message_key"), freeze_ms(F.col("kickoff_utc")).alias("freeze_ms"))
    grouped = rows.withColumn("key_group", F.pmod(F.xxhash64("message_key"), F.lit(KEY_GROUPS))).groupBy("fixture_id", "key_group")
    schema = ", ".join(part for part in FIRSTS.split(", ") if part.split()[0] in names)
    return grouped.transformWithStateInPandas(FirstMessages(names), schema, "Append", "EventTime")


def alerts(moments: DataFrame, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """Alerts of a stream of (fixture_id, flagged_utc) moments: one a fixture and gap at most."""
    keeps_state(moments.sparkSession)
    rows = moments.withWatermark("flagged_utc", LATENESS)
    return rows.groupBy("fixture_id").transformWithStateInPandas(AlertGap(gap_minutes), ALERTS, "Append", "EventTime")
