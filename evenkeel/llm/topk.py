"""Exact top-k search by inner product: every query's kth score is found by histograms, then rows are filtered.

Queries and candidates are dealt to blocks of bounded size by a hash, and every pair of blocks is a cell.  A cell scores
all its pairs, and gives one row for each query with the counts of its scores in BINS bins; counts are summed over cells
(in the tasks first), and the bin that holds the kth highest score is the next round's range, until bins are one score
wide.  A last pass gives the rows above the kth score and, of those that tie with it, those with the smallest ids.

Scores are integers and exact: matrix products in doubles where no sum can reach 2**53, Python integers beyond.  A score
beyond 2**62 - 1 is held to that (and so below zero).

Nulls and odd rows: vectors that are null, or hold null, NaN or infinite components, take no part.  Vectors of another
length than the query's are no candidates.  Empty vectors score 0 with each other.  A null id is never a query; as a
candidate it comes last among ties.  Of repeated rows each is a query and a candidate of its own, and only the row itself
is left out of its list.  Fewer than k candidates give all of them; an empty table gives none.  Columns beyond the two
named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import Scratch, ship

#: Bins of a histogram.
BINS = 64
#: Components (of 8 bytes) in a block of candidates or queries, in the mean.
BLOCK = 1 << 20
#: Scores that a task holds at a time.
TILE = 1 << 20
#: Blocks of candidates at least, so that small inputs keep several tasks busy.
LEAST_BLOCKS = 64
#: The largest score.
MOST = (1 << 62) - 1


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component as a double; null where a component is null or not finite."""
    made = F.transform(vector, lambda x: F.lit(float(scale)) * x.cast("double"))
    finite = F.forall(made, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # A double of 2**52 or more is whole, and may be beyond the longs that floor gives.
    return F.when(finite, F.transform(made, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and b (doubles that hold integers), held to -MOST..MOST."""
    reach = float(np.abs(a).max(initial=0.0)) * float(np.abs(b).max(initial=0.0)) * max(1, a.shape[1])
    if reach < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a).dot(whole(b).T), -MOST, MOST).astype(np.int64)


def _matrix(table: pa.Table) -> np.ndarray:
    flat = np.concatenate([np.zeros(0), *(c.flatten().to_numpy(zero_copy_only=False) for c in table.column("v").chunks)])
    return flat.reshape(table.num_rows, len(flat) // max(1, table.num_rows))


def _tiles(queries: pa.Table, rows: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of parts of the cell's candidates: the first one's place, the scores of all queries, and which pairs count."""
    if not queries.num_rows or not rows.num_rows:
        return
    q, c, own, others = _matrix(queries), _matrix(rows), queries.column("row").to_numpy(), rows.column("row").to_numpy()
    step = max(1, TILE // len(q))
    for at in range(0, len(c), step):
        yield at, scores(q, c[at : at + step]), own[:, None] != others[None, at : at + step]


def _counter(width: int, bins: int) -> Callable:
    def count(queries: pa.Table, rows: pa.Table) -> pa.Table:
        low = queries.column("low").to_numpy()[:, None]
        first = np.arange(len(low))[:, None] * bins
        held = np.zeros(len(low) * bins, np.int64)
        for _, s, counts in _tiles(queries, rows):
            at = (s - low) // width
            held += np.bincount((first + at)[counts & (at >= 0) & (at < bins)], minlength=len(held))
        offsets = pa.array(np.arange(0, len(held) + 1, bins), pa.int32())
        return pa.table({"row": queries.column("row"), "counts": pa.ListArray.from_arrays(offsets, pa.array(held))})

    return count


def _taker() -> Callable:
    def take(queries: pa.Table, rows: pa.Table) -> pa.Table:
        low, need = queries.column("low").to_numpy()[:, None], queries.column("need").to_numpy()
        place = np.empty(rows.num_rows, np.int64)  # of each row by id, nulls last
        place[pc.sort_indices(rows, sort_keys=[("id", "ascending")]).to_numpy()] = np.arange(rows.num_rows)
        query, row, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        ties: dict[int, np.ndarray] = {}
        for at, s, counts in _tiles(queries, rows):
            i, j = np.nonzero(counts & (s > low))
            query.append(i)
            row.append(j + at)
            score.append(s[i, j])
            tied = counts & (s == low)
            for i in np.nonzero(tied.any(axis=1))[0]:
                found = np.concatenate([ties.get(i, row[0]), np.nonzero(tied[i])[0] + at])
                ties[i] = found if len(found) <= need[i] else found[np.argpartition(place[found], need[i] - 1)[: need[i]]]
        for i, found in ties.items():
            query.append(np.full(len(found), i))
            row.append(found)
            score.append(np.full(len(found), low[i, 0]))
        of, at = pa.array(np.concatenate(query)), pa.array(np.concatenate(row))
        return pa.table({"row": queries.column("row").take(of), "query_id": queries.column("id").take(of), "id": rows.column("id").take(at), "score": pa.array(np.concatenate(score))})

    return take


def _kth(counts: Column, need: Column, bins: int) -> Column:
    """The bin, from the top, in which the counts reach `need` (the lowest if they don't), and the count above it."""
    going = F.struct(F.lit(0).cast("long").alias("above"), F.lit(-1).alias("bin"))

    def step(state: Column, i: Column) -> Column:
        n = F.coalesce(F.element_at(counts, i + 1), F.lit(0).cast("long"))
        here = (state["above"] + n >= need) | (i == 0)
        return F.when(state["bin"] >= 0, state).otherwise(F.struct((state["above"] + F.when(here, F.lit(0)).otherwise(n)).alias("above"), F.when(here, i).otherwise(F.lit(-1)).alias("bin")))

    return F.aggregate(F.sequence(F.lit(bins - 1), F.lit(0), F.lit(-1)), going, step)


def top_k(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, bins: int = BINS) -> DataFrame:
    """query_id, rank (from 1), id and score of the k highest inner products of each row for which is_query holds, ties to
    smaller ids (bigints)."""
    ship(spark)
    scratch = Scratch(spark, "topk")
    made = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    # Written once, so that a row's number stands.
    rows = scratch.keep(made.where("v IS NOT NULL").select(F.monotonically_increasing_id().alias("row"), "id", "v", F.size("v").alias("dim"), "asks"), "rows")
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, asked, dim, squared = rows.agg(F.count("*"), F.count_if("asks"), F.max("dim"), F.max(squares)).first()
    # No score is beyond the longest vector's own square.
    reach = MOST if (squared or 0.0) > MOST / 2 else int((squared or 0.0) * (1 + 1e-9)) + 1
    rounds = 1
    while bins**rounds < 2 * reach + 1:
        rounds += 1
    a_block = max(1, BLOCK // max(1, dim or 0))
    by_query, by_row = max(1, math.ceil(asked / a_block)), max(LEAST_BLOCKS, math.ceil(n / a_block))
    block = lambda salt, blocks: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    cell = ["dim", "block", "part"]
    candidates = rows.select("row", "id", "v", "dim", every(by_query).alias("block"), block("row", by_row).alias("part"))

    def cells(state: DataFrame, run: Callable, schema: str) -> DataFrame:
        dealt = state.withColumn("block", block("query", by_query)).withColumn("part", every(by_row))
        return dealt.groupBy(*cell).cogroup(candidates.groupBy(*cell)).applyInArrow(run, schema)

    # low: the least score of a query's range; need: how many of its k lie within.
    state = rows.where("asks").select("row", "id", "v", "dim", F.lit(-reach).cast("long").alias("low"), F.lit(k).cast("long").alias("need"))
    for r in reversed(range(rounds)):
        counted = cells(state, _counter(bins**r, bins), "row long, counts array<long>")
        summed = counted.groupBy("row").agg(F.array(*[F.sum(F.col("counts")[i]) for i in range(bins)]).alias("counts"))
        found = state.join(summed, "row", "left").withColumn("at", _kth(F.col("counts"), F.col("need"), bins))
        low = F.col("low") + F.col("at.bin").cast("long") * F.lit(bins**r).cast("long")
        state, last = scratch.keep(found.select("row", "id", "v", "dim", low.alias("low"), (F.col("need") - F.col("at.above")).alias("need")), f"range-{r}"), f"range-{r + 1}"
        scratch.drop(last)
    taken = cells(state, _taker(), "row long, query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return taken.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
