"""Joins and completeness checks that align the variants of a case."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Subgroups that comparisons are made of at most (a study has tens).
MOST_SUBGROUPS = 1000


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left outer join on keys that are compared as text where their types differ; unmatched rows have nulls."""
    for k in keys:
        if left.schema[k].dataType != right.schema[k].dataType:
            right = right.withColumn(k, F.col(k).cast(left.schema[k].dataType))
    return left.join(right, list(keys), "left")


def align(long: DataFrame, keys: Sequence[str], variant: str, value: str, variants: Sequence[str]) -> DataFrame:
    """One row per case with a column for each variant, kept only if every variant is there.

    Conditional aggregation takes one shuffle where a join per variant would take one each.
    """
    wide = long.where(F.col(variant).isin(*variants)).groupBy(*keys).agg(*[F.max(F.when(F.col(variant) == v, F.col(value))).alias(v) for v in variants])
    return wide.dropna(subset=list(variants))


def complete_only(long: DataFrame, keys: Sequence[str], variant: str, expected: int) -> DataFrame:
    """Rows of the cases that have `expected` distinct variants."""
    whole = long.groupBy(*keys).agg(F.count_distinct(variant).alias("__n")).where(F.col("__n") == expected).select(*keys)
    return long.join(whole, list(keys), "left_semi")


def pending(items: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items that are not done yet."""
    return items.join(done.select(*keys).distinct(), list(keys), "left_anti")


def checked_lookup(rows: DataFrame, targets: DataFrame, keys: Sequence[str], at_once: bool = True) -> DataFrame:
    """Inner join to a table with one row per key; an error if a row has no target.

    at_once asks first, at the price of another pass.  Otherwise the check is part of the one join (an outer join whose
    unmatched rows raise), and the error comes when the result is computed.
    """
    if at_once and not rows.join(targets, list(keys), "left_anti").isEmpty():
        raise ValueError(f"rows without a match on {', '.join(keys)}")
    mark = "__found"
    joined = rows.join(targets.withColumn(mark, F.lit(True)), list(keys), "left")
    message = F.concat(F.lit("a row without a match: "), F.to_json(F.struct(*keys)))
    return joined.where(F.when(F.col(mark).isNull(), F.raise_error(message).cast("boolean")).otherwise(True)).drop(mark)


def grid(spark: SparkSession, **values: Sequence) -> DataFrame:
    """All combinations of short parameter lists (the lists are the caller's literals, not tables)."""
    out = None
    for name, vs in values.items():
        one = spark.createDataFrame([(v,) for v in vs], [name])
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


def unordered_pairs(items: DataFrame, position: str, name: str) -> DataFrame:
    """Pairs a < b by position of a short list of items, such as subgroups."""
    a = items.select(F.col(position).alias("pa"), F.col(name).alias("a"))
    b = items.select(F.col(position).alias("pb"), F.col(name).alias("b"))
    if (n := b.limit(MOST_SUBGROUPS + 1).count()) > MOST_SUBGROUPS:
        raise ValueError(f"{n} items or more; pairs are made of {MOST_SUBGROUPS} subgroups at most")
    return a.join(F.broadcast(b), F.col("pa") < F.col("pb")).select("a", "b")


def contrasts(source: DataFrame, unit: str, attributes: Sequence[str], reference: Mapping[str, object]) -> DataFrame:
    """Rows that differ from the unit's reference row in exactly one attribute, beside that row.

    Columns: unit, axis, level, and the other columns of the contrast row and of the reference (`ref_` in front).
    """
    rest = [c for c in source.columns if c != unit and c not in attributes]
    differs = [F.when(~F.col(a).eqNullSafe(F.lit(v)), F.lit(a)) for a, v in reference.items()]
    axes = F.array_compact(F.array(*differs))
    tagged = source.withColumn("__axes", axes)
    ref = tagged.where(F.size("__axes") == 0).select(unit, *(F.col(c).alias(f"ref_{c}") for c in rest))
    level = F.coalesce(*[F.when(F.element_at("__axes", 1) == a, F.col(a).cast("string")) for a in attributes])
    one = tagged.where(F.size("__axes") == 1).select(unit, F.element_at("__axes", 1).alias("axis"), level.alias("level"), *rest)
    return one.join(ref, unit)


def named(index: Column, names: Sequence[str]) -> Column:
    """The i-th of a list of names; null beyond the list."""
    return F.get(F.array(*[F.lit(n) for n in names]), index.cast("int"))


def by_position(rows: DataFrame, group: Sequence[str], order: Sequence[str], names: Sequence[str], name: str = "name") -> DataFrame:
    """Gives the i-th row of each group the i-th of a list of names, starting anew in each group; null beyond the list."""
    from evenkeel.operators.windows import index_within_large

    return index_within_large(rows, group, order, "__i").withColumn(name, named(F.col("__i"), names)).drop("__i")


def grouped_map(rows: DataFrame, keys: Sequence[str], key: str, value: str, name: str = "variants") -> DataFrame:
    """A map from `key` to `value` for each case (keys must be distinct within a case)."""
    return rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name))


def triple(scores: DataFrame, comparisons: DataFrame, value: str) -> DataFrame:
    """For each comparison (a, b) and unit: the score of a, of b, and of a's benign variants.

    scores: unit, subgroup, variant_type (demographic, paraphrase or fixed_sentence), comparison (null but for
    paraphrases), value.  comparisons: a short table (comparison, a, b).  A unit needs both demographic scores; benign
    ones may be missing.
    """
    if (n := comparisons.limit(MOST_SUBGROUPS**2 + 1).count()) > MOST_SUBGROUPS**2:
        raise ValueError(f"{n} comparisons or more; {MOST_SUBGROUPS**2} at most are sent to the workers")
    pairs = F.broadcast(comparisons)
    demo = scores.where("variant_type = 'demographic'").select("unit", "subgroup", F.col(value).alias("v"))
    a = demo.join(pairs, F.col("subgroup") == F.col("a")).select("comparison", "a", "b", "unit", F.col("v").alias("original"))
    b = demo.select("unit", F.col("subgroup").alias("b"), F.col("v").alias("swapped"))
    para = scores.where("variant_type = 'paraphrase'").select("unit", F.col("subgroup").alias("a"), "comparison", F.col(value).alias("paraphrase"))
    fixed = scores.where("variant_type = 'fixed_sentence'").select("unit", F.col("subgroup").alias("a"), F.col(value).alias("fixed"))
    return a.join(b, ["unit", "b"]).join(para, ["unit", "a", "comparison"], "left").join(fixed, ["unit", "a"], "left").select("comparison", "unit", "original", "swapped", "paraphrase", "fixed")


def dataset_not(column: str, value: str) -> Column:
    """column != value that keeps nulls."""
    return ~F.col(column).eqNullSafe(F.lit(value))
