"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: For intermediate tables: small Arrow batches, and files that are few and large, since each costs its writer several calls of the file system.
LEAN = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m"}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode only, a temporary folder where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", folder := "file://" + tempfile.mkdtemp(prefix="sedimenta-"))
    return folder


def spread(df: DataFrame, enough: int = 128 << 20) -> DataFrame:
    """The rows over all cores where Spark expects fewer bytes than `enough` for each of them, as a file of one row group is one task however it is
    split; what is shuffled is small then. Larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * enough else df


class Scratch:
    """Tables written once and read many times; a lost executor costs a reread, not a recomputation."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.root = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Written with small Arrow batches, as rows that hold whole texts or sets take a worker's and the JVM's memory batch by batch, and in few files."""
        conf = self.spark.conf
        before = {k: conf.get(k) for k in LEAN}  # put back whatever happens
        for k, v in LEAN.items():
            conf.set(k, v)
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            for k, v in before.items():
                conf.set(k, v)
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more; those that aren't there are passed over."""
        for name in names:
            self._delete(self.path(name))

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session has ended
            pass
