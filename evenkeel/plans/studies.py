"""Analyses of whole experiments, each one call: batteries, held-out models, gates, merges.

All return result tables of a few rows for each cell; cases are only ever scanned, summed and shuffled as partial sums.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions import divergence as dv
from evenkeel.operators import windows
from evenkeel.plans import battery as bt
from evenkeel.plans import stats
from evenkeel.scratch import Scratch


def _stacked(df: DataFrame, baselines: Mapping[str, str], name: str = "baseline") -> DataFrame:
    """One copy of the cases for each benign variant, which becomes `logit_baseline`; cases without it are left out."""
    keep = [c for c in df.columns if c not in baselines.values()]
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias(name), F.col(c).alias("logit_baseline")) for k, c in baselines.items()]))
    return df.select(*keep, kinds.alias("__k")).select(*keep, "__k.*").where("logit_baseline IS NOT NULL")


# Directional study: regressions, in sample and held out -------------------------------------------------------------


def _join(a: DataFrame, b: DataFrame, cells: Sequence[str]) -> DataFrame:
    return a.join(b, list(cells)) if cells else a.crossJoin(b)


def held_out_difference(train: DataFrame, test: DataFrame, cells: Sequence[str], x: Column, y: Column) -> DataFrame:
    """y = beta * x fitted on one split: rmse and r2 on the other, against its own mean (0 where it does not vary)."""
    fit = stats.ols_through_origin(train, cells, x, y).select(*cells, "beta")
    rows = _join(test.select(*cells, x.alias("x"), y.alias("y")), windows.few(fit), cells)
    return stats.held_out(rows, cells, F.col("y"), F.col("beta") * F.col("x"))


def held_out_level(train: DataFrame, test: DataFrame, cells: Sequence[str], z: str, s: str, y: str) -> DataFrame:
    """y = a + b z + c s against y = a + b z, both fitted on one split: r2_full, r2_null, delta_r2 and rmse on the other."""
    m = train.groupBy(*cells).agg(
        F.avg(z).alias("mz"), F.avg(s).alias("ms"), F.avg(y).alias("my"), F.var_pop(z).alias("vz"), F.var_pop(s).alias("vs"),
        F.covar_pop(z, s).alias("zs"), F.covar_pop(z, y).alias("zy"), F.covar_pop(s, y).alias("sy"),
    )
    det = F.col("vz") * F.col("vs") - F.col("zs") * F.col("zs")
    sound = det > 1e-12 * F.col("vz") * F.col("vs")
    part = lambda a: F.when(sound, a / F.when(sound, det).otherwise(1.0))
    fit = m.select(*cells, "mz", "ms", "my", part(F.col("vs") * F.col("zy") - F.col("zs") * F.col("sy")).alias("b"), part(F.col("vz") * F.col("sy") - F.col("zs") * F.col("zy")).alias("c"), F.try_divide("zy", "vz").alias("b0"))
    rows = _join(test.select(*cells, F.col(z).alias("z"), F.col(s).alias("s"), F.col(y).alias("y")), windows.few(fit), cells)
    dz = F.col("z") - F.col("mz")
    full = F.col("y") - F.col("my") - F.col("b") * dz - F.col("c") * (F.col("s") - F.col("ms"))
    null = F.col("y") - F.col("my") - F.col("b0") * dz
    g = rows.groupBy(*cells).agg(F.count("y").cast("double").alias("n"), F.sum(full * full).alias("full"), F.sum(null * null).alias("null"), (F.var_pop("y") * F.count("y")).alias("sst"))
    r2 = lambda c: 1.0 - F.try_divide(F.col(c), F.col("sst"))
    return g.select(*cells, "n", r2("full").alias("r2_full"), r2("null").alias("r2_null"), (r2("full") - r2("null")).alias("delta_r2"), F.sqrt(F.col("full") / F.col("n")).alias("rmse"))


def directional(cases: DataFrame, cells: Sequence[str], split: Column, baselines: Mapping[str, str], direction: str = "swap_direction", cluster: str = "cluster_id") -> DataFrame:
    """Both regressions for each baseline, fitted on the train cases (split) and on the rest, and held out.

    One row per cell, baseline and regression (`A_difference`, `B_level`): beta, one- and two-sided p on both splits, rmse
    and, for the level model, r2_full, r2_null and delta_r2.  The level model stacks each case's benign variant
    (direction 0) and its targeted one.  Cases without the benign variant are left out.
    """
    by = [*cells, "baseline"]
    rows = _stacked(cases.withColumn("__train", split), baselines)
    delta = F.col("logit_swapped") - F.col("logit_baseline")
    pair = F.array(F.struct(F.lit(0.0).alias("s"), F.col("logit_baseline").alias("y")), F.struct(F.col(direction).cast("double").alias("s"), F.col("logit_swapped").alias("y")))
    level = rows.select(*by, "__train", cluster, F.col("logit_original").alias("z"), F.explode(pair).alias("p")).select(*by, "__train", cluster, "z", "p.*")

    def on(df: DataFrame, train: bool) -> DataFrame:
        return df.where("__train" if train else "NOT __train")

    def fits(model, df: DataFrame, beta: str, t: Column, label: str) -> DataFrame:
        two = []
        for train, name in ((True, "train"), (False, "test")):
            m = model(on(df, train))
            two.append(m.select(*by, F.col(beta).alias(f"beta_{name}"), F.col("p_less").alias(f"p_one_{name}"), t.alias(f"p_two_{name}")))
        return two[0].join(two[1], by, "full").withColumn("regression", F.lit(label))

    a = fits(lambda d: stats.ols_through_origin(d, by, F.col(direction), delta), rows, "beta", 2.0 * F.least(F.col("p_less"), 1.0 - F.col("p_less")), "A_difference")
    b = fits(lambda d: stats.ols_clustered(d, by, "z", "s", "y", cluster), level, "c", F.col("p_two"), "B_level")
    held_a = held_out_difference(on(rows, True), on(rows, False), by, F.col(direction), delta)
    held_b = held_out_level(on(level, True), on(level, False), by, "z", "s", "y")
    none = F.lit(None).cast("double")
    out_a = a.join(held_a.select(*by, "rmse"), by, "left").withColumns({c: none for c in ("r2_full", "r2_null", "delta_r2")})
    return out_a.unionByName(b.join(held_b.drop("n"), by, "left"))


# Non-directional and controlled batteries ----------------------------------------------------------------------------


def nondirectional(cases: DataFrame, cells: Sequence[str], baselines: Mapping[str, str], replicates: int = 1000) -> DataFrame:
    """The five metrics for each cell (model, split, ...) and baseline, one row with a group of columns for each metric:
    targeted, baseline, diff, p_one in the metric's direction, p_two; t for the paired metrics."""
    by = [*cells, "baseline"]
    rows = _stacked(cases, baselines)
    long = bt.battery(rows, by, 1, replicates)
    p = dv.probabilities(rows, po="logit_original", pp="logit_swapped", pb="logit_baseline")
    paired = p.groupBy(*by).agg(*[c for m, f in bt.SAMPLE.items() for c in stats.moments(f(F.col("po"), F.col("pp")) - f(F.col("po"), F.col("pb")), m)])
    ts = paired.select(*by, *[F.when((F.col(f"{m}_n") > 1) & (F.col(f"{m}_sd") > 0), F.col(f"{m}_mean") * F.sqrt(f"{m}_n") / F.when(F.col(f"{m}_sd") > 0, F.col(f"{m}_sd")).otherwise(1.0)).otherwise(0.0).alias(f"{m}_t") for m in bt.SAMPLE])
    short = {"statistic_perturbation": "targeted", "statistic_baseline": "baseline", "difference": "diff", "p_one": "p_one", "p_two": "p_two"}
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{short[c]}")
    wide = long.groupBy(*by).agg(F.max("n").alias("n"), *[pick(m, c) for m in [*stats.POPULATION, *bt.SAMPLE] for c in short])
    return wide.join(ts, by)


def controlled(cases: DataFrame, cells: Sequence[str], g: str, b: str, g_flip: Column, b_flip: Column, averages: Sequence[str] = ()) -> DataFrame:
    """The controlled battery of two divergences per case, targeted g and benign b, and of two flips, in one row per cell:
    descriptives, paired t, Wilcoxon, Cohen's d, overlap of flips, McNemar, and means of the columns `averages`.

    Cases with both divergences are paired by the row that they stand in; others only count as cases.  What is asked of
    a case is computed once and written, as some ten sums read it.
    """
    narrow = cases.select(*[F.col(c) for c in dict.fromkeys([*cells, g, b, *averages])], g_flip.alias("__g"), b_flip.alias("__b"))
    rows = Scratch(cases.sparkSession, "controlled").keep(narrow, "cases")
    both = rows.where(F.col(g).isNotNull() & F.col(b).isNotNull())
    d = F.round(F.col(g) - F.col(b), 9)  # equal differences tie, whatever their last bits
    t = stats.paired_t(both, cells, d).select(*cells, F.col("mean").alias("mean_diff"), "t", F.col("p_two").alias("t_p_two"), F.col("p_greater").alias("t_p_one"))
    w = stats.wilcoxon(both, cells, d).select(*cells, F.col("w").alias("wilcoxon"), F.coalesce("p_exact", "p_two").alias("wilcoxon_p"))
    medians = [windows.quantiles(both, c, (0.5,), cells, again=True).withColumnRenamed("q0", f"median_{k}") for k, c in (("g", g), ("b", b))]
    basic = rows.groupBy(*cells).agg(F.count("*").alias("n_cases"), F.avg(g).alias("mean_g"), F.avg(b).alias("mean_b"), F.stddev_pop(g).alias("sd_g"), F.stddev_pop(b).alias("sd_b"), *[F.avg(c).alias(f"mean_{c}") for c in averages], F.count_if(F.col("__g") & ~F.col("__b")).cast("double").alias("__x"), F.count_if(~F.col("__g") & F.col("__b")).cast("double").alias("__y"))
    stat, p = stats.mcnemar(F.col("__x"), F.col("__y"))
    out = basic.withColumns({"mcnemar": stat, "mcnemar_p": p}).drop("__x", "__y")
    for part in (t, w, *medians, stats.cohens_d(both, cells, d), stats.overlap(rows, cells, F.col("__g"), F.col("__b"))):
        out = out.join(part, list(cells), "left") if cells else out.crossJoin(part)
    return out


# Gates ---------------------------------------------------------------------------------------------------------------


def gate(df: DataFrame, name: str, ok: Column) -> DataFrame:
    """One row: gate, n, n_ok, passed (there are rows, and all are ok; null counts as not ok)."""
    g = df.agg(F.count("*").alias("n"), F.count_if(F.coalesce(ok, F.lit(False))).alias("n_ok"))
    return g.select(F.lit(name).alias("gate"), "n", "n_ok", ((F.col("n") > 0) & (F.col("n") == F.col("n_ok"))).alias("passed"))


def preflight(units: DataFrame, masses: DataFrame, paraphrases: DataFrame, effects: DataFrame, contrasts: int, least_mass: float = 0.99) -> DataFrame:
    """The gates before an evaluation, a row for each.

    units (unit, contrast): every unit has all contrasts.  masses (mass): the answers' tokens hold least_mass of the
    probability.  paraphrases (deviation, actual, target, present, absent): within 0.5 or an undershoot; and reference
    demographics kept and no others brought in.  effects (contrast, effect): means by contrast are finite; and not all 0.
    """
    whole = units.groupBy("unit").agg(F.count_distinct("contrast").alias("k"))
    means = effects.groupBy("contrast").agg(F.avg("effect").alias("mean"))
    finite = ~F.isnan("mean") & (F.abs("mean") != float("inf"))
    some = means.agg(F.bool_or(F.abs("mean") > 1e-9).alias("some"))
    parts = [
        gate(whole, "contrasts", F.col("k") == contrasts), gate(masses, "mass", F.col("mass") >= least_mass),
        gate(paraphrases, "calibration", (F.col("deviation") <= 0.5) | (F.col("actual") <= F.col("target"))),
        gate(paraphrases, "demographics", F.col("present") & ~F.col("absent")),
        gate(means, "finite_effects", finite), gate(some, "some_effect", F.col("some")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def require(gates: DataFrame) -> None:
    """Raises if a gate has not passed, and names it."""
    failed = [r["gate"] for r in gates.where("passed IS DISTINCT FROM true").limit(20).collect()]
    if failed:
        raise ValueError(f"gates failed: {', '.join(failed)}")


class GatesFailed(ValueError):
    """Results that were not kept; `gates` is the table of what was asked of them."""

    def __init__(self, gates: DataFrame, failed: Sequence[str]):
        super().__init__(f"gates failed: {', '.join(failed)}")
        self.gates = gates


def keep_if(spark: SparkSession, root: str, tables: Mapping[str, tuple[DataFrame, Mapping[str, Column]]]) -> DataFrame:
    """Writes tables to folders below root, but only if all of their gates pass; returns the gates, a row for each.

    tables: by name, the rows and what must hold for each of them, by the gate's name.  Rows are counted as they are
    written, in the same pass; a null is no pass, and neither is a table without rows.  Everything is written beside its
    place first and moved there at the end; a failed gate leaves nothing, and raises GatesFailed.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(root).getFileSystem(conf)
    if taken := [t for t in tables if fs.exists(at(f"{root}/{t}"))]:
        raise FileExistsError(f"{root} holds {', '.join(taken)}")
    staged, rows = f"{root}/_staged-{uuid.uuid4().hex}", []
    try:
        for name, (df, gates) in tables.items():
            seen = Observation()
            # The topmost node: its tasks are those that write, which count once, whatever has to be done again below.
            df.observe(seen, F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(g) for g, c in gates.items()]).write.parquet(f"{staged}/{name}")
            told = seen.get
            rows += [(g, told["n"], told[g], told["n"] > 0 and told["n"] == told[g]) for g in gates]
        out = spark.createDataFrame(rows, "gate string, n long, n_ok long, passed boolean")
        if failed := [r[0] for r in rows if not r[3]]:
            raise GatesFailed(out, failed)
        for name in tables:
            fs.rename(at(f"{staged}/{name}"), at(f"{root}/{name}"))
        return out
    finally:
        fs.delete(at(staged), True)


def inconsistent(samples: DataFrame, question: str, n: str) -> DataFrame:
    """Questions whose cases were sampled unequally often."""
    return samples.groupBy(question).agg(F.count_distinct(n).alias("counts"), F.min(n).alias("least"), F.max(n).alias("most")).where("counts > 1")


# Merge, dedupe, analyse ------------------------------------------------------------------------------------------------


def merged(shards: DataFrame, shard: str, expected: int, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Rows of all shards, the first of each key; an error if there are fewer shards than expected."""
    n = shards.select(shard).distinct().count()
    if n < expected:
        raise ValueError(f"{n} of {expected} shards are there")
    return windows.first_wins(shards, keys, order)


def three_phases(attempts: DataFrame, keys: Sequence[str], phase: str, target: str, actual: str, order: str, tolerance: float = 0.5) -> DataFrame:
    """The candidate that a search in phases keeps: 1 rewrites in conversation, 2 synonyms, asked only where all of 1
    overshoot.

    The first within the tolerance (in phase 2 only where it was asked); else the closest undershoot; else the closest.
    Adds phase, accepted and asked (whether phase 2 was).
    """
    over = F.col(actual) > F.col(target) + tolerance
    first = attempts.where(F.col(phase) == 1).groupBy(*keys).agg(F.bool_and(over).alias("asked"))
    some = attempts.join(first, list(keys)).where((F.col(phase) == 1) | F.col("asked"))
    off = F.abs(F.col(actual) - F.col(target))
    kind = F.when(off <= tolerance, 0).when(F.col(actual) <= F.col(target), 1).otherwise(2)
    rank = F.struct(kind, F.when(kind == 0, 0.0).otherwise(off), F.col(phase), F.col(order))
    picked = some.groupBy(*keys).agg(F.min_by(F.struct(phase, actual, order), rank).alias("r"), F.min(kind).alias("kind"), F.bool_or("asked").alias("asked"))
    return picked.select(*keys, f"r.{phase}", f"r.{actual}", f"r.{order}", (F.col("kind") == 0).alias("accepted"), "asked")
