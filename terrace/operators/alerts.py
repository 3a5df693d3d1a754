"""Alert rate limit: at most one alert per fixture and gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP_MINUTES = 15


def throttle(moments: DataFrame, gap: int = GAP_MINUTES) -> DataFrame:
    """Minutes that raise an alert: the first, then each one ``gap`` or more after the last alert.

    The fold runs over a fixture's distinct minutes, a list bounded by the
    length of a match however many rows flagged them.
    """
    minutes = moments.select("fixture_id", "minute").distinct().groupBy("fixture_id").agg(
        F.sort_array(F.collect_list("minute")).alias("_m")
    )
    none = F.array().cast("array<bigint>")
    start = F.struct(F.lit(None).cast("bigint").alias("last"), none.alias("kept"))
    kept = F.aggregate(
        "_m", start,
        lambda acc, m: F.when(
            acc["last"].isNull() | (m - acc["last"] >= gap),
            F.struct(m.alias("last"), F.concat(acc["kept"], F.array(m)).alias("kept")),
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )
    return minutes.select("fixture_id", F.explode(kept).alias("minute"))
