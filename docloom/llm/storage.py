"""Cutting lineage through the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Unset (a single-machine session, as in tests): one of its own is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read back from reliable storage."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def apart(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data, computed by itself and never broadcast, so that plans are alike at every size and hot keys can be split."""
    return cut(df).hint("merge")


def column(name: str) -> Column:
    """The column of just this name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


BATCH_BYTES = 8 << 20


def lean(df: DataFrame) -> DataFrame:
    """df; its session hands rows to Python in batches of BATCH_BYTES (one row at least), unless it is set to fewer.

    The setting is read when a plan runs, which is after the call, so it stays; it
    changes no result.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(key) or ""
    if not (now.isdigit() and int(now) <= BATCH_BYTES):
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df
