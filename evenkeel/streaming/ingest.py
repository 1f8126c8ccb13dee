"""Incremental scoring: resume against what is written, and a stream of score records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evenkeel.operators.alignment import pending


def resume(spark: SparkSession, items: DataFrame, done_path: str, keys: Sequence[str]) -> DataFrame:
    """Items without a finished record.  A folder that is not there, or has no finished write, counts as empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(done_path)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(done_path, "_SUCCESS")):
        return items
    return pending(items, spark.read.parquet(done_path), keys)


def score_stream(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, keys: Sequence[str], event_time: str, late: str = "1 hour") -> StreamingQuery:
    """Score records from a growing folder, each key once within the lateness allowed, appended to `out`."""
    rows = spark.readStream.schema(schema).parquet(source)
    once = rows.withWatermark(event_time, late).dropDuplicatesWithinWatermark(list(keys))
    return once.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)


def flip_stream(spark: SparkSession, source: str, schema: str, event_time: str, window: str, late: str, name: str) -> StreamingQuery:
    """Flip rates of a stream by event-time window and cell, into a table in memory; for dashboards and tests."""
    rows = spark.readStream.schema(schema).parquet(source).withWatermark(event_time, late)
    rates = rows.groupBy(F.window(event_time, window).alias("w"), "cell").agg(F.count("*").alias("n"), F.avg((F.col("original") != F.col("edited")).cast("double")).alias("flip"))
    return rates.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
