"""Session settings and the two plan helpers that depend on the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Scans below this size are spread over the cores by an explicit exchange;
# anything larger already brings one task per file split.
FAN_OUT_BYTES = 256 * 1024 * 1024


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options the operators rely on; safe on a shared session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # try_cast / get() are used where bad input must become NULL
    spark.conf.set("spark.sql.ansi.enabled", "true")
    # batches to Python are bounded by rows and bytes, so a worker holds the same however large the input or a text is
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def local_session(cores: str = "8", app: str = "terrace", memory: str = "8g") -> SparkSession:
    """Local session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def estimated_bytes(df: DataFrame) -> int:
    """Optimizer's size estimate of a frame (file metadata only, no job)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fan_out(df: DataFrame) -> DataFrame:
    """Spread a small scan over all cores before heavy per-row work.

    One small file is one task however many cores there are. Large inputs are
    returned unchanged: their splits already outnumber the cores, and shuffling
    raw text would cost more than it gains.
    """
    if estimated_bytes(df) > FAN_OUT_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, from ``spark.checkpoint.dir``.

    Only a local master without that setting (tests) gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    return tempfile.mkdtemp(prefix="terrace-shared-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so a lost executor costs no recompute."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The rows as a compressed table in the shared folder: smaller than a checkpoint, and read by column.

    Row groups are small, so a task that writes or reads wide rows holds few of them.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", str(16 << 20)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
