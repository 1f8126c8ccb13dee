"""The five-metric battery: targeted against benign edits, by cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions import divergence as dv
from evenkeel.plans import stats

#: Row metrics: name -> divergence of (original, edited) probabilities.  Others are added here.
SAMPLE = {"jsd": dv.jsd_bits, "kl": dv.kl_bits_clipped}


def answers(triples: DataFrame, o: str = "logit_original", p: str = "logit_swapped", b: str = "logit_baseline") -> DataFrame:
    """Adds the binary answers o, p, b: a logit above 0; null for a logit that is null or NaN."""
    return triples.withColumns({n: F.when(dv.known(F.col(c)), (F.col(c) > 0).cast("int")) for n, c in (("o", o), ("p", p), ("b", b))})


def battery(triples: DataFrame, cells: Sequence[str], tests: int, replicates: int = 1000, alpha: float = 0.05, draws: str = "random") -> DataFrame:
    """One row per cell and metric: n, both arms' statistics, their difference, p_two, p_one and its direction, flag.

    Count metrics are bootstrapped from eight counts, row metrics tested by paired t.
    """
    rows = answers(triples)
    counts = stats.triple_counts(rows, cells, "o", "p", "b")
    boot = stats.bootstrap(counts, cells, replicates, draws=draws)
    arms = counts.select(*cells, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), f(stats.margins("p")).alias("statistic_perturbation"), f(stats.margins("b")).alias("statistic_baseline"), F.lit(side).alias("alternative")) for m, (f, side) in stats.POPULATION.items()])).alias("a")).select(*cells, "a.*")
    out = boot.join(arms, [*cells, "metric"]).select(*cells, "metric", "n", "statistic_perturbation", "statistic_baseline", F.col("observed").alias("difference"), "p_two", F.when(F.col("alternative") == "less", F.col("p_less")).otherwise(F.col("p_greater")).alias("p_one"), "alternative")
    # Row metrics of both arms in one scan and one shuffle: moments of all metrics side by side, long afterwards.
    p = dv.probabilities(rows, po="logit_original", pp="logit_swapped", pb="logit_baseline")
    both = p.select(*cells, *[f(F.col("po"), F.col(q)).alias(f"{m}_{q}") for m, f in SAMPLE.items() for q in ("pp", "pb")])
    long = [stats.moments(F.col(f"{m}_pp") - F.col(f"{m}_pb"), m) + [F.avg(f"{m}_pp").alias(f"{m}_x"), F.avg(f"{m}_pb").alias(f"{m}_y")] for m in SAMPLE]
    wide = both.groupBy(*cells).agg(*[c for cs in long for c in cs])
    each = [F.struct(F.lit(m).alias("metric"), *[F.col(f"{m}_{k}").alias(k) for k in ("n", "mean", "sd", "x", "y")]) for m in SAMPLE]
    t = stats.t_test(wide.select(*cells, F.explode(F.array(*each)).alias("m")).select(*cells, "m.*"))
    sample = t.select(*cells, "metric", "n", F.col("x").alias("statistic_perturbation"), F.col("y").alias("statistic_baseline"), F.col("mean").alias("difference"), "p_two", F.col("p_greater").alias("p_one"), F.lit("greater").alias("alternative"))
    return out.unionByName(sample).withColumn("significant", stats.bonferroni(F.col("p_two"), tests, alpha))


def control_passes(results: DataFrame, cells: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Whether no metric of the cell detects anything, and star labels."""
    stars = F.when(F.col("p_two") < 0.001, "***").when(F.col("p_two") < 0.01, "**").when(F.col("p_two") < 0.05, "*").otherwise("")
    return results.withColumn("stars", stars).groupBy(*cells).agg(F.bool_and(F.col("p_two") > alpha).alias("passes"), F.sort_array(F.collect_list(F.concat("metric", "stars"))).alias("labels"))


def survival(results: DataFrame, axis: Sequence[str], unit: Sequence[str]) -> DataFrame:
    """By axis: how many units have a significant metric, of how many."""
    units = results.groupBy(*axis, *unit).agg(F.bool_or("significant").alias("any"))
    return units.groupBy(*axis).agg(F.count_if("any").alias("survived"), F.count("*").alias("units"))


def dose_response(votes: DataFrame, level: str, task: str, o: str, e: str) -> DataFrame:
    """Flip rate, mutual information and its n by level and task."""
    c = stats.pair_counts(votes, [level, task], o, e)
    four = {n: F.col(n) for n in ("n00", "n01", "n10", "n11")}
    return c.select(level, task, (four["n00"] + four["n01"] + four["n10"] + four["n11"]).alias("n"), stats.flip_rate(four).alias("flip_rate"), stats.mutual_information(four).alias("mi"))


def calibration_summary(power: DataFrame) -> DataFrame:
    """False-positive rates (sigma_pert = 0, sigma > 0) overall, by metric and by condition, in one pass."""
    null = power.where("sigma_pert = 0 AND sigma > 0")
    return null.groupingSets([[], ["metric"], ["condition"]], "metric", "condition").agg(F.avg("detection_rate").alias("mean_rate"), F.max("detection_rate").alias("max_rate"), F.count("*").alias("n"))


def error_bars(counts: DataFrame, cells: Sequence[str]) -> DataFrame:
    """n, flip rate and its standard error for each cell, in order: what a plot with error bars draws."""
    four = {n: F.col(n) for n in ("n00", "n01", "n10", "n11")}
    c = counts.select(*cells, sum(list(four.values())[1:], four["n00"]).alias("n"), stats.flip_rate(four).alias("flip_rate"))
    return c.withColumn("se", F.sqrt(F.col("flip_rate") * (1 - F.col("flip_rate")) / F.col("n"))).orderBy(*cells)
