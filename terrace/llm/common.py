"""Helpers shared by the pipeline operators: scratch tables, bounded batches, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.session import shared_dir

_ROOTS: dict[str, str] = {}


def settings(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a batch of very long texts stays small; shuffle files go with the query that made them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    # written tables cut every lineage here, so no later query needs the shuffles behind them
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path in the shared checkpoint folder."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = shared_dir(spark)
    return f"{_ROOTS[app].rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "lz4") -> DataFrame:
    """The rows as a table in the shared folder: what follows never recomputes them."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes sum to ``most`` at the largest; one larger row stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def table_of(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def filtered(docs: DataFrame, mask: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """Rows of ``docs`` that ``mask`` (a boolean for each row of a batch) keeps, with all columns, unshuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(mask(batch), pa.bool_()))
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, docs.schema)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; component is its smallest reachable node.

    ``edges`` has long columns (u, v). Alternating large-star and small-star
    steps; each round is a written table, hubs are handled by partial
    aggregation and joins that can be split.
    """
    pairs = stored(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    seen = None
    for _ in range(rounds):
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.greatest("v", "m").alias("u"), F.col("m").alias("v")),
            F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        pairs = stored(small, "edges")
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    star = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return star.union(roots)
