"""Stored tables: scans with fixed schemas, sorted exports, keyed merges, JSON rows.

A keyed table is a folder of appended rows; the newest write of a key speaks for
it when the table is read. A merge therefore reads nothing and changes nothing
that is there: writers of different keys never meet, of two writers of one key
the later one counts, and a writer that is killed before its commit leaves no
row. Rows lie in hash buckets of their first key, not in a folder for each
fixture, which would leave millions of tiny files. ``compact`` writes the
current rows as a fresh table, apart from the write path.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace import schemas
from terrace.schemas import column_names


@dataclass(frozen=True)
class Keyed:
    """A merged table: rows are replaced by ``keys``, or all rows of a ``replace_by`` prefix at once."""

    schema: str
    keys: tuple[str, ...]
    replace_by: tuple[str, ...] = ()
    buckets: int = 64


MATCH_ARCHIVE = Keyed(schemas.ARCHIVE, ("match_id", "minute"), ("match_id",))
MATCH_RESULTS = Keyed(schemas.RESULTS, ("match_id",))
RUN_STATUS = Keyed(schemas.RUN_STATUS, ("match_id",))
REACTIONS = Keyed(schemas.STORED_REACTIONS, ("match_id", "message_hash"))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet table, or no rows with the same schema when it does not exist."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return empty(spark, schema)
        raise


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def upsert(new: DataFrame, path: str, table: Keyed, at: int | None = None) -> None:
    """Keyed merge: one append; the same merge run twice reads as once.

    ``at`` orders the writes, the clock by default; a stream passes its batch
    number, so that a replayed tick takes the place of its first run. ``new`` may
    itself come from the table. No rows: nothing changes.
    """
    stamped = new.select(*column_names(table.schema)).withColumns({
        "_at": F.lit(time.time_ns() // 1000 if at is None else at).cast("bigint"),
        "_token": F.lit(uuid.uuid4().hex if at is None else ""),
        "bucket": bucket(F.col(table.keys[0]), table.buckets),
    })
    # one file of a small bucket, several of a large one
    stamped.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", *table.keys).write.mode("append").option(
        "compression", "zstd"
    ).partitionBy("bucket").parquet(path)


def load(spark: SparkSession, path: str, table: Keyed, only: str | None = None) -> DataFrame:
    """Current rows of a merged table, optionally of one fixture: prunes to its bucket, pushes the filter."""
    rows = scan(spark, path, f"{table.schema}, _at BIGINT, _token STRING, bucket INT")
    if only is not None:
        rows = rows.filter((F.col("bucket") == bucket(F.lit(only), table.buckets)) & (F.col(table.keys[0]) == only))
    write = F.struct("_at", "_token")
    if table.replace_by:
        newest = rows.groupBy(*table.replace_by).agg(F.max(write).alias("_newest"))
        rows = rows.join(newest, list(table.replace_by)).filter(write == F.col("_newest")).drop("_newest")
    names = column_names(table.schema)
    rest = [c for c in names if c not in table.keys]
    kept = rows.groupBy(*table.keys).agg(F.max_by(F.struct(*rest), write).alias("_row"))
    return kept.select(*table.keys, "_row.*").select(*names)


def compact(spark: SparkSession, path: str, target: str, table: Keyed) -> None:
    """The current rows as a new table in ``target``."""
    upsert(load(spark, path, table), target, table)


def export_sorted(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Globally sorted zstd Parquet; the range exchange splits a hot first key."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").option(
        "compression", "zstd"
    ).parquet(path)


def replace_tables(frames: dict[str, DataFrame], base: str) -> None:
    """Write the run tables anew, each as a folder of ``base``."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").option("compression", "zstd").parquet(f"{base}/{name}")


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("compression", "zstd").parquet(path)


def write_status(status: DataFrame, path: str) -> None:
    status.write.mode("overwrite").json(path)


def read_status(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Heartbeats; none when the file is absent, unreadable rows dropped."""
    try:
        rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return empty(spark, schema)
        raise
    return rows.filter(F.col("match_id").isNotNull())


def json_safe(df: DataFrame) -> DataFrame:
    """NaN to NULL and times to ISO text, so every row serialises."""
    picked = []
    for field in df.schema.fields:
        col = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            col = F.when(~F.isnan(col), col)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            micros = F.date_format(col, "SSSSSS")
            col = F.concat(
                F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss"),
                F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)),
            )
        elif isinstance(field.dataType, T.DateType):
            col = F.concat(F.date_format(col, "yyyy-MM-dd"), F.lit("T00:00:00"))
        picked.append(col.alias(field.name))
    return df.select(*picked)


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON object, NULLs kept."""
    safe = json_safe(df)
    return safe.select(F.to_json(F.struct(*safe.columns), {"ignoreNullFields": "false"}).alias("row"))


def labelled_text(parts: Sequence[tuple[DataFrame, str | None]], labels: dict[int, str]) -> DataFrame:
    """Union of splits with their language, label codes mapped to names."""
    mapping = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    out = None
    for frame, lang in parts:
        part = frame if lang is None else frame.withColumn("lang", F.lit(lang))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("y", F.try_element_at(mapping, F.col("label")))
