"""Tables in the shared folder named by ``spark.checkpoint.dir``: they cut lineage and survive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read. A local session without the setting gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="cleaveset-"))
    return spark.conf.get("spark.checkpoint.dir")


class Store:
    """Parquet tables of one operator run. ``drop`` frees those that are no longer read; the rest go with the application."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/cleaveset-{uuid.uuid4().hex}"
        path = self._path(self.root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)

    def _path(self, at: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)

    def keep(self, df: DataFrame, name: str, codec: str = "zstd", partition: str | None = None) -> DataFrame:
        """Write ``df`` and return the written table; shuffle files of the write are freed when it ends."""
        at = f"{self.root}/{name}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            writer = df.write.option("compression", codec)
            (writer.partitionBy(partition) if partition else writer).parquet(at)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str) -> None:
        path = self._path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
