"""Session helpers: where lineage may be cut and how many pieces a wide step should make."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Largest number of bytes of rows that any operator may broadcast after counting them.
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by all executors, which the session names in spark.checkpoint.dir.

    Only a session whose executors are threads of this process may go without: it gets a fresh folder of its own.
    """
    context = spark.sparkContext
    jsc = context._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="sonoframe-ckpt-"))
    return jsc.getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and goes on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its files give fewer than half as many partitions: for steps that cost far more than a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path beside the checkpoints, where all executors can write and read."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs of this thread that ``cancel`` with the same tag ends."""
    context = spark.sparkContext
    context.addJobTag(tag)
    context.setInterruptOnCancel(True)
    try:
        yield
    finally:
        context.setInterruptOnCancel(False)
        context.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Ends the running jobs of a tag; what they wrote so far is left to their committers."""
    spark.sparkContext.cancelJobsWithTag(tag)
