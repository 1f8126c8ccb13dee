"""Packing: concatenate and cut.

Pass one tokenises each text once and writes, for each partition, its documents' ids with their offsets in that
partition.  The partitions' totals (one number each) give global offsets by a prefix sum.  Pass two cuts each document
at the multiples of the sequence length; a piece that starts or ends at a cut is a boundary record.  No row is
shuffled, and no sequence but the last has padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evenkeel.llm.common import Scratch, col, ship, slices
from evenkeel.llm.tokenise import encoder

WIDTH = 4  # bytes of an id
AT_ONCE = (4096, 4_000_000)  # texts and bytes that are encoded together


def _tokens(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int) -> DataFrame:
    key = T.StructField("key", docs.schema[id_col].dataType)
    schema = T.StructType([key, T.StructField("part", T.LongType()), T.StructField("before", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch in batches:
            for a, b in slices(batch.column(1), *AT_ONCE):
                rows = batch.slice(a, b - a)
                flat, offsets = enc.encode_flat(rows.column(1), end_id)
                ids = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((WIDTH * offsets).astype(np.int32)), pa.py_buffer(flat)])
                made = [rows.column(0), pa.array(np.full(b - a, part)), pa.array(before + offsets[:-1]), pa.array(np.diff(offsets)), ids]
                before += int(offsets[-1])
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(made, arrow, strict=True)], schema=arrow)

    return docs.select(col(id_col).alias("key"), col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of sequences of `length` ids: one row per document and sequence that it touches.

    Columns: id_col, start (the document's ids before the piece), length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset, sequence_tokens (of its sequence), padded_length (`length`; in the last sequence
    its own token count where that is a power of two).
    A null or empty text is its end id alone.  Repeated rows and null ids are documents of their own.  An empty table
    gives no rows.  Other columns are not read.  The order of documents is that of the input's partitions.
    `part` totals are the only thing that the driver collects: one number per input partition.
    """
    ship(spark)
    scratch = Scratch(spark, "packing")
    tokens = scratch.keep(_tokens(docs, id_col, text_col, tokenizer, end_id), "tokens")
    base, rows = 0, []
    for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        rows.append((r["part"], base))
        base += r["n"]
    total = base
    bases = spark.createDataFrame(rows, "part long, base long")
    at = F.col("base") + F.col("before")
    size = F.lit(length).cast("long")

    def piece(s):
        low = F.greatest(s * size - at, F.lit(0).cast("long"))
        high = F.least((s + 1) * size - at, F.col("n"))
        held = F.least(size, F.lit(total).cast("long") - s * size)
        power = held.bitwiseAND(held - 1) == 0
        ids = F.substring(F.col("ids"), (low * WIDTH + 1).cast("int"), ((high - low) * WIDTH).cast("int"))
        return F.struct(low.alias("start"), (high - low).alias("length"), ids.alias("ids"), F.col("n").alias("doc_tokens"), s.alias("sequence_id"), F.greatest(at - s * size, F.lit(0).cast("long")).alias("offset"), held.alias("sequence_tokens"), F.when(power, held).otherwise(size).alias("padded_length"))

    whole = F.sequence(F.floor(at / size).cast("long"), F.floor((at + F.col("n") - 1) / size).cast("long"))
    made = tokens.join(F.broadcast(bases), "part").select(F.col("key").alias(id_col), F.explode(F.transform(whole, piece)).alias("p"))
    return made.select(col(id_col), "p.*")
