"""A long run whose work is kept piece by piece, and which goes on where it was cut off.

Rows are dealt to pieces by a hash of their keys.  A wave of pieces is worked on and written; once its files are whole, a
line for each piece is added to the commit log: wave, piece, files, bytes, rows and a checksum of the rows.  A later run
reads the log, leaves out pieces whose files are torn (missing, cut or, if asked, changed) and files without a line, works
on what is missing, and the result is made of logged pieces alone.  Every step may be repeated without harm.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.scratch import exists

LOG = "wave string, piece int, files long, bytes long, rows long, checksum long"


def piece_of(keys: Sequence[str], pieces: int) -> Column:
    text = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % pieces).cast("int")


@dataclass
class Pieces:
    """The pieces of one run, below `root`, a folder that all executors share."""

    spark: SparkSession
    root: str
    keys: Sequence[str]
    pieces: int = 64
    #: Pieces of a wave: what is lost at most when a run is cut off.
    at_once: int = 8

    def _files(self) -> DataFrame:
        """wave, piece, files and bytes of what lies there, from the folder's listing; no file is opened."""
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.root}/data").select("path", "length")
        at = lambda name: F.regexp_extract("path", rf"/__{name}=([^/]+)/", 1)
        return listed.groupBy(at("wave").alias("wave"), at("piece").cast("int").alias("piece")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))

    def _rows(self, schema: T.StructType, torn: bool = False) -> DataFrame:
        """All that lies there, with __wave and __piece; torn: files that cannot be read are passed over."""
        places = T.StructType([*schema.fields, T.StructField("__wave", T.StringType()), T.StructField("__piece", T.IntegerType())])
        return self.spark.read.schema(places).option("ignoreCorruptFiles", str(torn)).option("ignoreMissingFiles", str(torn)).parquet(f"{self.root}/data")

    def _sums(self, schema: T.StructType) -> DataFrame:
        sums = self._rows(schema, torn=True).groupBy("__wave", "__piece").agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*schema.names)).alias("checksum"))
        return sums.select(F.col("__wave").alias("wave"), F.col("__piece").alias("piece"), "rows", "checksum")

    def whole(self, schema: T.StructType, read: bool = False) -> DataFrame:
        """The log's lines, one a piece, whose files are all there with all their bytes; read: and hold the same rows."""
        if not exists(self.spark, f"{self.root}/_log"):
            return self.spark.createDataFrame([], LOG)
        log = self.spark.read.schema(LOG).json(f"{self.root}/_log").distinct()
        full, empty = log.where("rows > 0"), log.where("rows = 0")
        if exists(self.spark, f"{self.root}/data"):
            full = full.join(self._files(), ["wave", "piece", "files", "bytes"], "left_semi")
            if read:
                full = full.join(self._sums(schema), ["wave", "piece", "rows", "checksum"], "left_semi")
        else:
            full = full.limit(0)
        lines = full.unionByName(empty)
        return lines.groupBy("piece").agg(F.max(F.struct(*[c for c in log.columns if c != "piece"])).alias("r")).select("r.wave", "piece", "r.files", "r.bytes", "r.rows", "r.checksum")

    def run(self, df: DataFrame, work: Callable[[DataFrame], DataFrame], waves: int | None = None, read: bool = False) -> list[int]:
        """Works on the pieces that are not whole yet, `waves` waves of them at most, and returns their numbers.

        work keeps the keys; its schema must be that of earlier runs.
        """
        schema = work(df).schema
        done = {r["piece"] for r in self.whole(schema, read).select("piece").collect()}
        left = [p for p in range(self.pieces) if p not in done]
        worked: list[int] = []
        for i in range(0, len(left), self.at_once)[:waves]:
            wave, now = f"w-{uuid.uuid4().hex}", left[i : i + self.at_once]
            made = work(df.where(piece_of(self.keys, self.pieces).isin(now)))
            made.withColumns({"__wave": F.lit(wave), "__piece": piece_of(self.keys, self.pieces)}).write.mode("append").partitionBy("__wave", "__piece").parquet(f"{self.root}/data")
            lines = self._files().where(F.col("wave") == wave).join(self._sums(schema).where(F.col("wave") == wave), ["wave", "piece"])
            none = self.spark.createDataFrame([(wave, p) for p in now], "wave string, piece int")
            lines = none.join(lines, ["wave", "piece"], "left").fillna(0, ["files", "bytes", "rows"])
            lines.select("wave", "piece", "files", "bytes", "rows", "checksum").coalesce(1).write.mode("append").json(f"{self.root}/_log")
            worked += now
        return worked

    def result(self, schema: T.StructType) -> DataFrame:
        """The rows of all pieces; an error where a piece is not whole."""
        lines = self.whole(schema).select(F.col("wave").alias("__wave"), F.col("piece").alias("__piece"), "rows").collect()
        if missing := sorted(set(range(self.pieces)) - {r["__piece"] for r in lines}):
            raise ValueError(f"{len(missing)} of {self.pieces} pieces are not finished: {missing[:10]}")
        if not any(r["rows"] for r in lines):
            return self.spark.createDataFrame([], schema)
        # One line a piece, and as many pieces as the caller has asked for.
        logged = F.broadcast(self.spark.createDataFrame([(r["__wave"], r["__piece"]) for r in lines], "__wave string, __piece int"))
        return self._rows(schema).join(logged, ["__wave", "__piece"], "left_semi").select(*schema.names)
