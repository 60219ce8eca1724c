"""Session settings, table access and durable intermediate results."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("taxoflow")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate results.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset, as on
    one machine in tests, a temporary folder is used.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = named or tempfile.mkdtemp(prefix="taxoflow-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage.

    The rows outlive the executors that made them. ``df`` is computed once, at the call.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a side that may be sent whole to every executor.
BROADCAST_ROWS = 200_000


def bounded_rows(df: DataFrame, limit: int = BROADCAST_ROWS) -> list | None:
    """All rows of ``df`` if there are at most ``limit``, else None.

    Reads one row more than the limit, so that an unexpectedly large table never
    reaches the driver.
    """
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


__all__ = ["BROADCAST_ROWS", "bounded_rows", "checkpoint_dir", "durable", "local_session", "table"]
