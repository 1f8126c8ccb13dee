"""Several sampled answers to each prompt, from a model that takes batches.

Rows are buffered, ordered by length, and cut into batches whose padded size stays within a budget of tokens; results go
back in the rows' order.  Every sample has a seed that follows from its row and its number alone, so that batches,
partitions and repeated tasks make no difference.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evenkeel.functions.parse import clamped
from evenkeel.session import ship


class Model(Protocol):
    """Texts and log-odds, one for each prompt and seed of a batch."""

    def __call__(self, prompts: Sequence[str], seeds: Sequence[int]) -> Sequence[tuple[str | None, float]]: ...


SAMPLE = T.ArrayType(T.StructType([T.StructField("sample_index", T.IntegerType()), T.StructField("seed", T.LongType()), T.StructField("text", T.StringType()), T.StructField("logit", T.DoubleType())]))


def seed(keys: Sequence[str], index: Column) -> Column:
    """32 bits of the md5 of the keys and the sample's number, as text with colons between."""
    text = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], index.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def batches(lengths: Sequence[int], budget: int, most: int) -> Iterator[list[int]]:
    """Places of rows in batches, long rows first: so many rows that their number times the longest of them is within the
    budget, and `most` of them at most.  A row that is longer than the budget is a batch of its own."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    at = 0
    while at < len(order):
        n = max(1, min(most, budget // max(1, lengths[order[at]])))
        yield order[at : at + n]
        at += n


def sample(
    df: DataFrame, keys: Sequence[str], prompt: str, make: Callable[[], Model], samples: int = 10, budget: int = 1 << 14, most: int = 64, buffer: int = 2048,
    length: Callable[[str], int] = lambda t: len(t.split()), name: str = "samples",
) -> DataFrame:
    """Adds an array of `samples` structs: number, seed, text and log-odds (NaN as 0, infinities as +-100, null as null).

    make() is called once per task; `length` counts a prompt's tokens.  A task holds `buffer` rows at a time, or those of
    about 32 million letters.  Rows with a null prompt have null samples, and ask for nothing.  A model that gives another
    number of answers than it was asked for is an error.
    """
    ship(df.sparkSession)
    numbered = df.withColumn("__seeds", F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: seed(keys, i)))
    schema = T.StructType([*df.schema.fields, T.StructField(name, SAMPLE)])
    arrow, at = to_arrow_schema(schema), df.columns.index(prompt)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()

        def told(part: pa.RecordBatch) -> pa.RecordBatch:
            prompts, seeds = part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist()
            rows = [i for i, p in enumerate(prompts) if p is not None]
            out: list[list[dict] | None] = [None if p is None else [] for p in prompts]
            sizes = [length(prompts[i]) for i in rows]
            for batch in batches(sizes, budget, most):
                asked = [rows[j] for j in batch]
                for k in range(samples):
                    answers = model([prompts[i] for i in asked], [seeds[i][k] for i in asked])
                    for i, (text, logit) in zip(asked, answers, strict=True):
                        out[i].append({"sample_index": k, "seed": seeds[i][k], "text": text, "logit": logit})
            kept = [c.cast(f.type) for c, f in zip(part.columns[:-1], arrow, strict=False)]
            return pa.RecordBatch.from_arrays([*kept, pa.array(out, arrow.field(len(arrow) - 1).type)], schema=arrow)

        for b in source:
            letters = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False)) if b.num_rows else np.zeros(0)
            i = 0
            while i < b.num_rows:
                end = max(i + 1, min(i + buffer, int(np.searchsorted(letters, (letters[i - 1] if i else 0) + (32 << 20), side="right"))))
                yield told(b.slice(i, end - i))
                i = end

    made = numbered.mapInArrow(run, schema)
    sane = F.transform(name, lambda s: s.withField("logit", clamped(s["logit"])))
    return made.withColumn(name, sane)
