"""Deterministic picks, shards and samples over windows.  Every order is total: ties are broken by the columns given."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.scratch import Scratch

#: Rows that a table sent to all workers may have; it is joined by a shuffle beyond that.
BROADCAST_ROWS = 500_000
#: Rows of a group that a task may rank.
WINDOW_ROWS = 1_000_000
#: A quantile is looked for among this share of the values on either side, as a sketch of this size places them (within
#: 2e-4 of the values, mostly).
MARGIN, SKETCH = 5e-4, 32_768


def _c(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order.

    A minimum of structs: partial sums keep one row of a key for each task before the shuffle, so that a hot key moves
    little.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*_c(order))) if rest else F.count("*")
    out = df.groupBy(*keys).agg(best.alias("__row"))
    return out.select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest)).select(*df.columns)


def hashed(seed: int, *names: str) -> Column:
    """A reproducible random order: md5 of the seed and the columns as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names)))


def few(df: DataFrame, label: str = "few") -> DataFrame:
    """df (one row for each group, say), computed and written once; marked for sending to all workers if it is small."""
    kept = Scratch(df.sparkSession, label).keep(df, "rows")
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def _same(group: Sequence[str]) -> list[Column]:
    return [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]


def balanced_sample(df: DataFrame, group: Sequence[str], ids: Sequence[str], seed: int = 42) -> DataFrame:
    """As many rows of each group as the smallest has, picked by a hash of the ids and numbered in a hashed order.

    Rows are first cut at a hash that leaves each group about that many and a margin of ten standard deviations, so that
    what is ranked does not grow with a large group; a group that the cut leaves short (as where ids repeat) is ranked
    whole.  Where that is more than WINDOW_ROWS rows, ranks are taken from the order of the whole table, so that no task
    holds a group.
    """
    sizes = few(df.groupBy(*group).agg(F.count("*").alias("__size")))
    least = sizes.agg(F.min("__size")).first()[0] or 0
    place = F.conv(F.substring(hashed(seed, *ids), 1, 8), 16, 10).cast("double") / float(1 << 32)
    joined = df.alias("a").join(sizes.alias("b"), _same(group)).select("a.*", (place <= (least + 10.0 * (least + 1) ** 0.5) / F.col("__size")).alias("__in"))
    short = few(joined.groupBy(*group).agg(F.count_if("__in").alias("__left")).where(F.col("__left") < least).select(*group, F.lit(True).alias("__whole")))
    cut = joined.alias("a").join(short.alias("b"), _same(group), "left").select("a.*", "__whole").where("__in OR __whole")
    if least > WINDOW_ROWS or not short.isEmpty():
        ranked = index_within_large(cut.select(*df.columns), group, [hashed(seed, *ids), *ids], "__rn")
    else:
        ranked = index_within(cut.select(*df.columns), group, [hashed(seed, *ids), *ids], "__rn")
    return ranked.where(F.col("__rn") < least).select(*df.columns, hashed(seed + 1, *ids).alias("shuffled"))


def _placed(df: DataFrame, keys: list[Column], label: str) -> tuple[DataFrame, DataFrame, int]:
    """Rows written once in their order, each with its place (`__part`, `__in`), a row (`__part`, `__base`) for each
    part, and the number of rows.

    The order is that of range partitions, sorted within; what is written no longer depends on how they were cut.
    """
    spark, columns = df.sparkSession, df.columns
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kept = Scratch(spark, label).keep(ranged.withColumn("__id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__id", 33)
    counts = kept.groupBy(part.alias("__part")).agg(F.count("*").alias("n")).orderBy("__part").collect()
    before, rows = 0, []
    for r in counts:  # one for each task of the sort
        rows.append((r["__part"], before))
        before += r["n"]
    bases = F.broadcast(spark.createDataFrame(rows, "__part long, __base long"))
    return kept.select(*columns, part.alias("__part"), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)).alias("__in")), bases, before


def _indexed(df: DataFrame, order: Sequence[str | Column], name: str) -> tuple[DataFrame, int]:
    placed, bases, n = _placed(df, _c(order), "row-index")
    return placed.join(bases, "__part").select(*df.columns, (F.col("__base") + F.col("__in")).alias(name)), n


def row_index(df: DataFrame, order: Sequence[str | Column], name: str = "rn") -> DataFrame:
    """A global number from 0 in the given order, without bringing all rows into one task.

    Rows are range-partitioned, sorted and written once with their places (by one shuffle); one count for each part is
    collected, and gives the parts' first numbers.  Rows that tie in the order are numbered in any order, but for good.
    """
    return _indexed(df, order, name)[0]


def stride_shard(df: DataFrame, order: Sequence[str], shards: int, shard: int) -> DataFrame:
    """Every shards-th row from number `shard`, in the given order."""
    return row_index(df, order, "__i").where(F.col("__i") % shards == shard).drop("__i")


def contiguous_shard(df: DataFrame, order: Sequence[str], shards: int, name: str = "shard") -> DataFrame:
    """Equal runs of floor(n / shards) rows; the remainder goes to the last."""
    indexed, n = _indexed(df, order, "__i")
    size = max(1, n // shards)
    return indexed.withColumn(name, F.least(F.floor(F.col("__i") / size), F.lit(shards - 1)).cast("long")).drop("__i")


def index_within(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str = "idx") -> DataFrame:
    """A number from 0 within each group, by a window; for groups that a task can hold."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*group).orderBy(*_c(order))) - 1).cast("long"))


def index_within_large(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str = "idx") -> DataFrame:
    """The same for groups of any size: numbers in the order of the whole table, less the group's first."""
    rows = row_index(df, [*group, *order], "__n")
    firsts = few(rows.groupBy(*group).agg(F.min("__n").alias("__first")))
    return rows.alias("a").join(firsts.alias("b"), _same(group)).select(*[F.col(f"a.{c}") for c in df.columns], (F.col("__n") - F.col("__first")).alias(name))


def running_total(df: DataFrame, order: Sequence[str | Column], weight: str, name: str = "before") -> DataFrame:
    """The sum of `weight` (double) over the rows before this one in the order of the whole table.

    Sums within a range partition are taken as it is written, those of the partitions before from one row for each.
    """
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, keys = df.sparkSession, _c(order)
    source = df.withColumn(weight, F.col(weight).cast("double"))
    schema = T.StructType([*source.schema.fields, T.StructField("__part", T.LongType()), T.StructField("__run", T.DoubleType())])
    arrow, at = to_arrow_schema(schema), source.columns.index(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0.0
        for b in batches:
            w = b.column(at).to_numpy(zero_copy_only=False)
            sums = total + np.cumsum(w)
            made = [*b.columns, pa.array(np.full(len(w), part)), pa.array(sums - w)]
            total = float(sums[-1]) if len(w) else total
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, arrow, strict=True)], schema=arrow)

    ranged = source.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kept = Scratch(spark, "running-total").keep(ranged.mapInArrow(run, schema), "ordered")
    before, rows = 0.0, []
    for r in kept.groupBy("__part").agg(F.sum(weight).alias("n")).orderBy("__part").collect():
        rows.append((r["__part"], before))
        before += r["n"]
    bases = F.broadcast(spark.createDataFrame(rows, "__part long, __base double"))
    return kept.join(bases, "__part").select(*source.columns, (F.col("__base") + F.col("__run")).alias(name))


def _marks(rows: DataFrame, value: str, shares: Sequence[float], group: Sequence[str], also: Sequence[Column] = ()) -> DataFrame:
    """For each group two values for each share, between which its quantile should lie; null where a sketch sees none.
    With the aggregates `also`."""
    points = F.array(*[F.lit(min(1.0, max(0.0, s + m))) for s in shares for m in (-MARGIN, MARGIN)])
    sketched = rows.groupBy(*group).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), SKETCH).alias("__s"), *also)
    return few(sketched.withColumn("__marks", F.when(F.kll_sketch_get_n_double("__s") > 0, F.kll_sketch_get_quantile_double("__s", points))).drop("__s"))


def _cells(rows: DataFrame, value: str, marks: DataFrame, shares: int, group: Sequence[str]) -> DataFrame:
    """Counts __w of the values between two marks by value, and of all others by the gap that they lie in; with the least
    and the largest value, __low and __high, of what was counted together."""
    v, ends = F.col(f"a.{value}"), [(F.col("__marks")[2 * i], F.col("__marks")[2 * i + 1]) for i in range(shares)]
    within, gap = F.lit(False), F.lit(0)
    for low, high in ends:
        within, gap = within | ((v >= low) & (v <= high)), gap + (v > high).cast("int")
    joined = rows.alias("a").join(marks.select(*group, "__marks").alias("b"), _same(group) or F.lit(True))
    seen = joined.select(*[F.col(f"a.{g}") for g in group], v.alias("__v"), F.when(within, v).alias("__value"), F.when(~within, gap).alias("__gap"))
    return seen.groupBy(*group, "__value", "__gap").agg(F.count("*").cast("double").alias("__w"), F.min("__v").alias("__low"), F.max("__v").alias("__high")).where("__low IS NOT NULL").drop("__value", "__gap")


def _picked(cells: DataFrame, groups: DataFrame, shares: Sequence[float], group: Sequence[str]) -> DataFrame:
    """q0, q1, ... of the groups from counts in the order of their values, and __loose, how many of the cells that were
    looked up stand for more than one value."""
    if cells.count() > WINDOW_ROWS:
        ranked = running_total(cells, [*group, "__high"], "__w", "__before")
    else:
        earlier = Window.partitionBy(*group).orderBy("__high").rowsBetween(Window.unboundedPreceding, -1)
        ranked = cells.withColumn("__before", F.coalesce(F.sum("__w").over(earlier), F.lit(0.0)))
    sizes = ranked.groupBy(*group).agg(F.sum("__w").alias("__n"), F.min("__before").alias("__first"))
    own = [F.col(f"a.{g}") for g in group]
    whole = few(groups.alias("a").join(sizes.alias("b"), _same(group) or F.lit(True), "left").select(*own, F.coalesce("__n", F.lit(0.0)).alias("__n"), "__first"))
    rows = whole.alias("a").join(ranked.alias("b"), _same(group) or F.lit(True), "left").select(*own, "__n", "__w", "__low", "__high", (F.col("__before") - F.col("__first")).alias("__at"))
    at = lambda k: (F.col("__at") <= k) & (k < F.col("__at") + F.col("__w"))
    out, wanted = [], F.lit(False)
    for i, share in enumerate(shares):
        rank = share * (F.col("__n") - 1)
        below, above = at(F.floor(rank)), at(F.least(F.floor(rank) + 1, F.col("__n") - 1))
        low, high = F.max(F.when(below, F.col("__high"))), F.max(F.when(above, F.col("__high")))
        out.append((low + (high - low) * F.max(rank - F.floor(rank))).alias(f"q{i}"))
        wanted = wanted | below | above
    return rows.groupBy(*group).agg(*out, F.count_if(wanted & (F.col("__low") != F.col("__high"))).alias("__loose"))


def quantiles(df: DataFrame, value: str, shares: Sequence[float], group: Sequence[str] = (), again: bool = False, also: Sequence[Column] = ()) -> DataFrame:
    """q0, q1, ... of each group (or of all, in one row): exact quantiles, linear between neighbours, of non-null values.

    A sketch gives two values of each group between which a quantile should lie.  Values between them are counted one by
    one, all others together, and the few ranks that are wanted are looked up in running counts (those of range partitions
    where they are many), so that neither all values are ordered nor does a task hold those of a group.  Groups where a
    rank lies elsewhere are done again with all their values.  Null without any value.  df is read once, and its columns
    written; or, if it may be read `again`, twice.  The aggregates `also` are taken along, under their names.
    """
    scratch = Scratch(df.sparkSession, "quantiles")
    rows = df.select(*group, value) if again else scratch.keep(df.select(*group, value), "rows")
    marks = _marks(rows, value, shares, group, also)
    took = lambda q: q.alias("a").join(marks.drop("__marks").alias("b"), _same(group) or F.lit(True)).select("a.*", *[F.col(f"b.{c}") for c in marks.columns if c not in (*group, "__marks")]) if also else q
    narrow = scratch.keep(_cells(rows, value, marks, len(shares), group), "narrow")
    got = scratch.keep(_picked(narrow, marks.select(*group, "__marks"), shares, group), "got")
    loose = got.where("__loose > 0")
    if loose.isEmpty():
        return took(got.drop("__loose"))
    back = few(loose.select(*group, F.lit(True).alias("__back")))
    rest = rows.where(F.col(value).isNotNull()).alias("a").join(back.alias("b"), _same(group) or F.lit(True), "left_semi")
    each = rest.groupBy(*group, F.col(value).alias("__low")).agg(F.count("*").cast("double").alias("__w")).withColumn("__high", F.col("__low"))
    done = _picked(scratch.keep(each, "whole"), back, shares, group)
    return took(got.where("__loose = 0").unionByName(done).drop("__loose"))


def head(df: DataFrame, order: Sequence[str | Column], k: int) -> DataFrame:
    return df.orderBy(*_c(order)).limit(k)


def best_so_far(df: DataFrame, group: Sequence[str], order: str, value: str, distance: str, name: str = "best") -> DataFrame:
    """The value at the least distance among the rows before this one."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.min_by(F.col(value), F.struct(F.col(distance), F.col(order))).over(w))


def few_shot(df: DataFrame, context: str, key: str, cost: str, budget: int, draws: int = 100, seed: int = 42) -> DataFrame:
    """Two other rows of the same context for each row: the first drawn pair whose costs fit the budget.

    Adds first and second (keys; null if no draw fits, or the context has fewer than three rows) and attempt.  Draws
    are hashes of the seed, the key and the attempt's number; each row makes `draws` of them, in its own shuffle key.
    """
    rows = index_within_large(df.select(context, key, cost), [context], [key], "__i")
    sized = rows.join(few(df.groupBy(context).agg(F.count("*").alias("__n"))), context).where("__n > 2")
    tried = sized.select(context, key, "__i", "__n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("attempt"))
    draw = lambda k, n: F.conv(F.substring(hashed(seed, key, "attempt", k), 1, 8), 16, 10).cast("long") % n
    tried = tried.withColumns({"__one": F.lit(1), "__two": F.lit(2)})
    tried = tried.withColumn("__a", draw("__one", F.col("__n") - 1))
    tried = tried.withColumn("__a", F.col("__a") + (F.col("__a") >= F.col("__i")).cast("long"))
    low, high = F.least("__a", "__i"), F.greatest("__a", "__i")
    second = draw("__two", F.col("__n") - 2)
    second = second + (second >= low).cast("long")
    tried = tried.withColumn("__b", second + (second >= high).cast("long"))
    one = rows.select(context, F.col("__i").alias("__a"), F.col(key).alias("first"), F.col(cost).alias("__ca"))
    two = rows.select(context, F.col("__i").alias("__b"), F.col(key).alias("second"), F.col(cost).alias("__cb"))
    fits = tried.join(one, [context, "__a"]).join(two, [context, "__b"]).where(F.col("__ca") + F.col("__cb") <= budget)
    best = fits.groupBy(context, key).agg(F.min_by(F.struct("first", "second", "attempt"), "attempt").alias("r")).select(context, key, "r.first", "r.second", "r.attempt")
    return df.join(best, [context, key], "left")
