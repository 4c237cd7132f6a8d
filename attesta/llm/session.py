"""Session helpers: table reading and cutting lineage in shared storage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch on the way to Python; Spark's own limit is 256 MB beside its 10,000 rows.
BATCH_BYTES = str(16 << 20)
#: The same where a lazy result carries whole texts to Python.
TEXT_BATCH_BYTES = 4 << 20
#: Rows of a few numbers that one task reads, and tasks that read such a table at least.
NARROW_ROWS, LEAST_PARTITIONS = 250_000, 16
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table through Spark's reader, whatever store it lies in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; a temporary one only in local mode where none is set (tests)."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if named or current:
        if not current:
            context.setCheckpointDir(named)
        return named or current
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(own := tempfile.mkdtemp(prefix="attesta-checkpoint-"))
    return own


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so later stages survive lost executors.

    Arrow batches on the way hold at most BATCH_BYTES (or one row), so that rows of any width fit a Python worker.
    """
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, BATCH_BYTES)
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold at most TEXT_BATCH_BYTES (or one row). A lazy result runs when its caller wants it, so the bound has to stay."""
    now = spark.conf.get(_BATCH, None)
    bytes_ = int(now) if now and now.isdigit() else -1
    if not 0 < bytes_ <= TEXT_BATCH_BYTES:
        spark.conf.set(_BATCH, str(TEXT_BATCH_BYTES))


def cut_narrow(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``cut`` for rows of a few numbers: partitions that hold few rows are read together, so that later shuffles write no crowd of tiny files.

    Where it is known that there are at most ``rows``, they are written together too.
    """
    together = lambda n: max(LEAST_PARTITIONS, n // NARROW_ROWS)
    if rows is not None:
        return cut(df.coalesce(together(rows)))
    seen = Observation()
    kept = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return kept.coalesce(together(seen.get["n"]))
