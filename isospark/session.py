"""Where lineage is cut: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, as a URI: what ``spark.checkpoint.dir`` or the context names.

    Where neither does, a local session gets a temporary folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="isospark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of a part of a shuffle that a task sorts or hashes.
PART_ROWS = 1 << 18


def parts_for(spark: SparkSession, rows: int) -> int:
    """Parts of a shuffle of ``rows`` rows: the session's number, or more where a part would have over ``PART_ROWS``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))


#: Shuffled bytes up to which a session of ``roomy`` puts small parts together again.
PART_BYTES = 8 << 20


def _like(spark: SparkSession) -> SparkSession:
    new = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if new.conf.isModifiable(k):
            new.conf.set(k, v)
    return new


def roomy(spark: SparkSession, rows: int) -> SparkSession:
    """A session whose shuffles have as many parts as ``rows`` rows need: ``spark`` itself where its own number will do.

    Else it is a new one with the settings of ``spark``, which stay as they are there.
    """
    n = parts_for(spark, rows)
    if n == parts_for(spark, 0):
        return spark
    new = _like(spark)
    new.conf.set("spark.sql.shuffle.partitions", n)
    new.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", PART_BYTES)
    return new


#: Bytes of a batch of rows that goes to Python, and rows that are read from Parquet at once, in a session of ``lean``.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 512


def lean(spark: SparkSession) -> SparkSession:
    """A session for tables of long texts: batches to Python are bounded in bytes, those read from Parquet are of few rows.

    It is a new one with the settings of ``spark``, which stay as they are there.
    """
    new = _like(spark)
    new.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    new.conf.set("spark.sql.parquet.columnarReaderBatchSize", BATCH_ROWS)
    return new


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into the parts that ``rows`` rows need; as it is where they need fewer than the session's number.

    Joins and groups by these keys, or by more than these, are then made within the parts.
    """
    n = parts_for(df.sparkSession, rows)
    return df.repartition(n, *keys) if rows > (n - 1) * PART_ROWS else df


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that later jobs and lost executors do not recompute it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder; unlike ``cut``, its size is known to the join planner."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
