"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of wide rows that are written or read together, about.
WIDE_BYTES = 16 << 20


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class Scratch:
    """Tables in the folder that the cluster names in spark.checkpoint.dir, which every executor can read.

    They stand in for lineage: a lost executor re-reads them.  Where the setting is absent (tests, local mode) a
    temporary folder is taken; a cluster without the setting is refused, for its executors would not see such files.  A
    folder of its own is removed when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, label: str, folder: str | None = None):
        """folder: a shared folder to be used as it is, so that a later run finds what an earlier one has written."""
        if folder:
            self.spark, self.root = spark, folder.rstrip("/")
            return
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="evenkeel-")
        self.spark, self.root = spark, f"{base.rstrip('/')}/evenkeel/{label}-{uuid.uuid4().hex}"
        # Results are read from here as long as the application runs; its end is that of the folder.
        at = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)

    def keep(self, df: DataFrame, name: str, codec: str = "zstd", wide: bool = False) -> DataFrame:
        """Writes df and returns a DataFrame that reads what was written.  wide: rows may take megabytes each; their sizes
        are looked at row by row, so that a writer or a reader holds few of them (a hundred at least otherwise)."""
        options = {"parquet.block.size": WIDE_BYTES, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1} if wide else {}
        df.write.option("compression", codec).options(**options).parquet(f"{self.root}/{name}")
        return self.read(df.schema, name)

    def keep_once(self, df: DataFrame, name: str) -> DataFrame:
        """What is there under the name if it is whole; else df, written now."""
        if exists(self.spark, f"{self.root}/{name}/_SUCCESS"):
            return self.read(df.schema, name)
        df.write.option("compression", "zstd").mode("overwrite").parquet(f"{self.root}/{name}")
        return self.read(df.schema, name)

    def read(self, schema: T.StructType, name: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Removes tables that no returned DataFrame reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)
