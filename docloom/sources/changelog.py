"""An append-only change log of Parquet commits with contiguous sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


class ChangeLog:
    """Rows (sequence, payload columns) in folders by commit. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), f"sequence long, {schema}"
        jvm = spark.sparkContext._jvm
        self._p = jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _floor(self) -> int:
        folder = self._p(f"{self.path}/_floor")
        return max((int(x.getPath().getName()) for x in self._fs.listStatus(folder)), default=0) if self._fs.exists(folder) else 0

    def read(self, start: int = 0, n: int | None = None) -> DataFrame:
        """Entries from sequence start on, at most n, in order."""
        if not self._fs.exists(self._p(f"{self.path}/log")):
            return self.spark.createDataFrame([], self.schema)
        found = self.spark.read.schema(self.schema).parquet(f"{self.path}/log").where(F.col("sequence") >= start).orderBy("sequence")
        return found if n is None else found.limit(n)

    def last(self) -> int:
        return max(self.read().agg(F.max("sequence")).first()[0] or 0, self._floor())

    def append(self, rows: DataFrame, order: str) -> int:
        """rows after the entries there, numbered in the given order. Numbers come from counts by partition, not one sort."""
        first = self.last()
        laid = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
        laid = laid.withColumn("_i", F.col("_i").bitwiseAND((1 << 33) - 1)).persist()
        sizes = laid.groupBy("_p").agg(F.count("*").alias("_n"))
        ahead = sizes.withColumn("_ahead", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
        numbered = laid.join(F.broadcast(ahead), "_p").withColumn("sequence", F.lit(first + 1) + F.col("_ahead") + F.col("_i"))
        numbered.select("sequence", *rows.columns).write.mode("append").parquet(f"{self.path}/log")
        laid.unpersist()
        return self.last()

    def truncate(self) -> int:
        """All entries go; later sequences go on after the last one."""
        last = self.last()
        self._fs.mkdirs(self._p(f"{self.path}/_floor"))
        self._fs.createNewFile(self._p(f"{self.path}/_floor/{last}"))
        self._fs.delete(self._p(f"{self.path}/log"), True)
        return last


def replay(log: DataFrame, done: DataFrame, key: str = "sequence") -> DataFrame:
    """Entries that weren't materialised yet."""
    return log.join(done.select(key), key, "left_anti").orderBy(key)


def resume(log: DataFrame, seq: str, after: int, n: int) -> DataFrame:
    """The next n entries after a checkpoint."""
    return log.where(F.col(seq) > after).orderBy(seq).limit(n)
