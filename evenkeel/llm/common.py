"""What the operators share: Arrow kernels over whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from evenkeel.scratch import Scratch as Scratch
from evenkeel.session import ship as ship

#: bytes.translate table that lower-cases A-Z and nothing else.
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: Rows that a kernel holds as Python objects at a time; bounds a worker's memory when texts are long.
ROWS_AT_ONCE = 256

#: Characters that a kernel takes at a time, unless one text alone has more.
CHARS_AT_ONCE = 4_000_000


#: Keys that count as hot at most.
MOST_HOT = 100_000
#: Rows of a key below which it is not hot.
LEAST_HOT = 1000


def join_hot(rows: DataFrame, by_key: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows joined to by_key (one row for each key, with the key's number of rows in the column n), hot keys apart.

    A key with more than total / MOST_HOT rows is hot.  There are fewer than MOST_HOT such keys, so that they can be sent
    to all workers, and rows of one key need not meet in one task; all others are joined by a shuffle.
    """
    hot = F.col(n) > max(LEAST_HOT, total // MOST_HOT)
    some = F.broadcast(by_key.where(hot))
    rest = rows.join(F.broadcast(by_key.where(hot).select(key)), key, "left_anti").join(by_key.where(~hot), key)
    return rows.join(some, key).unionByName(rest)


def left_join_hot(rows: DataFrame, by_key: DataFrame, key: str, value: str, n: str, total: int) -> DataFrame:
    """rows with the column `value` of by_key (null where the key, a bigint, has none), hot keys apart as in join_hot."""
    hot = F.col(n) > max(LEAST_HOT, total // MOST_HOT)
    first, other = fresh(rows, "__hot"), fresh(rows, "__other")
    told = rows.join(F.broadcast(by_key.where(hot).select(key, F.col(value).alias(first))), key, "left")
    # Rows of hot keys are spread; should such a row meet a key by chance, what it has already counts.
    told = told.withColumn(other, F.when(col(first).isNull(), col(key)).otherwise(F.xxhash64(F.monotonically_increasing_id())))
    told = told.join(by_key.where(~hot).select(F.col(key).alias(other), value), other, "left")
    return told.select(*map(col, rows.columns), F.coalesce(col(first), col(value)).alias(value))


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores in front if df has such a column already (in either case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def slices(texts: pa.Array, rows: int = ROWS_AT_ONCE, chars: int = CHARS_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of at most `rows` rows and about `chars` bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= rows or held + n > chars):
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def annotate(df: DataFrame, text: str, make: Callable[[], Callable[[list], dict[str, list]]], fields: T.StructType, name: str, keep: Sequence[str] | None = None) -> DataFrame:
    """df's columns `keep` (all by default) and one struct column `name` computed from the column `text`.

    make() is called once per task and returns a function from a list of texts (str or None) to a dict of lists, one
    for each field.  Each row is handled on its own, so that retries and any partitioning give the same rows.
    """
    keep = list(df.columns if keep is None else keep)
    inner = fresh(df, "__text")
    shared = keep.index(text) if text in keep else None
    source = df.select(*map(col, keep), *([] if shared is not None else [col(text).cast("string").alias(inner)]))
    at = len(keep) if shared is None else shared
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(name, fields)])
    arrow, kind = to_arrow_schema(schema), to_arrow_type(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                found = kernel(part.column(at).to_pylist())
                made = pa.StructArray.from_arrays([pa.array(found[f.name], type=f.type) for f in kind], fields=list(kind))
                kept = [part.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, made], schema=arrow)

    return source.mapInArrow(run, schema)
