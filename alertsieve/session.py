"""Session settings and materialised intermediates.

Intermediates that must not be recomputed differently after an executor loss
(a range partitioning, the state of an iteration) are written as parquet to the
shared folder named by ``spark.checkpoint.dir`` and read back.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

GROUP_ROWS_CONF = "spark.alertsieve.maxGroupRows"
DEFAULT_GROUP_ROWS = 2_000_000
MOST_PORTIONS = 8  # each portion reads the whole table once more
COLLECT_SECONDS = 5.0
_collected = 0.0


def build_session(app: str = "alertsieve", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators expect (UTC, AQE, skew join)."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master).config("spark.driver.memory", "20g").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def _conf(spark: SparkSession, key: str) -> str | None:
    value = spark.conf.get(key, None)
    return value or None


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediates: the cluster's setting, a local one only in local mode."""
    path = _conf(spark, "spark.checkpoint.dir") or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="alertsieve-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def max_group_rows(spark: SparkSession) -> int:
    """Rows of one key that a single task may sort; larger keys are split into blocks."""
    return int(_conf(spark, GROUP_ROWS_CONF) or DEFAULT_GROUP_ROWS)


def materialise(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and scan it from there; ``zstd`` takes less disk and more time."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/alertsieve/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._written_to = path
    return written


def portion_count(spark: SparkSession, rows: int) -> int:
    """In how many portions ``rows`` rows are shuffled where a shuffle of all at once would take too much disk."""
    return max(1, min(MOST_PORTIONS, rows // max_group_rows(spark)))


def materialise_portions(portions: Iterable[DataFrame]) -> DataFrame:
    """Write tables of one schema one after the other and scan them as one.

    The shuffle files of a portion are dropped before the next one is shuffled, so at most one portion's are on disk.
    """
    path, n, schema, spark = None, 0, None, None
    for df in portions:
        spark, schema = df.sparkSession, df.schema
        path = path or f"{shared_dir(spark).rstrip('/')}/alertsieve/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{path}/{n:03d}")
        n += 1
        del df
        drop_shuffles(spark)
    written = spark.read.schema(schema).parquet(*[f"{path}/{i:03d}" for i in range(n)])
    written._written_to = path
    return written


def drop_shuffles(spark: SparkSession) -> None:
    """Ask Spark to delete the shuffle files of finished plans: those that the driver's collector finds to be unused."""
    global _collected
    gc.collect()  # plans are held by their Python objects
    spark._jvm.System.gc()
    _collected = time.monotonic()


def release(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialise`` returned and that nothing reads any more, and the shuffle files of finished jobs.

    Call it once all that was derived from them is written. Spark deletes the shuffle files of plans that the driver's
    collector has found to be unused, so it's asked to look, though not more often than every ``COLLECT_SECONDS``.
    """
    for df in tables:
        path = getattr(df, "_written_to", None)
        if path is None:
            continue
        jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)
    spark = next((df.sparkSession for df in tables if df is not None), None)
    if spark is not None and time.monotonic() - _collected > COLLECT_SECONDS:
        drop_shuffles(spark)


def spread(df: DataFrame) -> DataFrame:
    """Repartition a scan of fewer files than cores before costly work on its rows.

    A file may hold a single row group, which only one task can read. With enough files the scan
    is parallel by itself and nothing is shuffled.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if len(df.inputFiles()) < want else df
