"""Tests and models whose work is reduced to sufficient statistics before anything is computed.

Every function takes a DataFrame of cases and the columns that name a cell, shuffles partial sums once, and works on
one row per cell from there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.special import chi2_sf, normal_sf, t_cdf, t_quantile_column, t_sf
from evenkeel.session import ship

# Counts ----------------------------------------------------------------------------------------------------------


def pair_counts(df: DataFrame, cells: Sequence[str], x: str | Column, y: str | Column) -> DataFrame:
    """n00, n01, n10, n11 of two binary columns."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return df.groupBy(*cells).agg(*[F.count_if((x == a) & (y == b)).cast("double").alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)])


def triple_counts(df: DataFrame, cells: Sequence[str], o: str, p: str, b: str) -> DataFrame:
    """The eight counts n_opb of (original, perturbed, benign) answers; all count metrics follow from them."""
    return df.groupBy(*cells).agg(*[F.count_if((F.col(o) == i) & (F.col(p) == j) & (F.col(b) == k)).cast("double").alias(f"n{i}{j}{k}") for i in (0, 1) for j in (0, 1) for k in (0, 1)])


def margins(arm: str) -> dict[str, Column]:
    """The four counts of (original, arm) from the eight; arm is p or b."""
    pick = (lambda i, j, k: f"n{i}{j}{k}") if arm == "p" else (lambda i, j, k: f"n{i}{k}{j}")
    return {f"n{i}{j}": F.col(pick(i, j, 0)) + F.col(pick(i, j, 1)) for i in (0, 1) for j in (0, 1)}


def flip_rate(c: dict[str, Column]) -> Column:
    """Share of differing answers; null without cases."""
    return F.try_divide(c["n01"] + c["n10"], c["n00"] + c["n01"] + c["n10"] + c["n11"])


def mutual_information(c: dict[str, Column]) -> Column:
    """In bits; empty cells of the table add nothing; null without cases."""
    n = c["n00"] + c["n01"] + c["n10"] + c["n11"]
    total = F.lit(0.0)
    for i in (0, 1):
        for j in (0, 1):
            k, row, column = c[f"n{i}{j}"], c[f"n{i}0"] + c[f"n{i}1"], c[f"n0{j}"] + c[f"n1{j}"]
            total = total + F.when(k > 0, k / n * F.log2(F.when(k > 0, k * n / (row * column)).otherwise(1.0))).otherwise(0.0)
    return F.when(n > 0, total)


def phi(c: dict[str, Column]) -> Column:
    """Phi coefficient in floating point; 0 where a margin is empty."""
    margin = (c["n10"] + c["n11"]) * (c["n00"] + c["n01"]) * (c["n01"] + c["n11"]) * (c["n00"] + c["n10"])
    return F.when(margin > 0, (c["n11"] * c["n00"] - c["n10"] * c["n01"]) / F.sqrt(F.when(margin > 0, margin).otherwise(1.0))).otherwise(0.0)


#: Count metrics: name -> (function of four counts, alternative).  Others are added here.
POPULATION = {"flip_rate": (flip_rate, "greater"), "mutual_information": (mutual_information, "less"), "phi": (phi, "less")}


def mcnemar(only_first: Column, only_second: Column) -> tuple[Column, Column]:
    """Continuity-corrected statistic and p; (0, 1) without discordant pairs."""
    n = only_first + only_second
    stat = F.when(n > 0, F.pow(F.abs(only_first - only_second) - 1.0, F.lit(2.0)) / F.when(n > 0, n).otherwise(1.0)).otherwise(0.0)
    return stat, F.when(n > 0, chi2_sf(stat)).otherwise(1.0)


def overlap(df: DataFrame, cells: Sequence[str], g: Column, b: Column) -> DataFrame:
    """Jaccard index, conditional and specific rates of two sets of flips; 0 where a denominator is."""
    n = df.groupBy(*cells).agg(F.count_if(g & b).cast("double").alias("both"), F.count_if(g & ~b).cast("double").alias("only_g"), F.count_if(b & ~g).cast("double").alias("only_b"))
    share = lambda a, d: F.coalesce(F.try_divide(a, d), F.lit(0.0))
    both, og, ob = F.col("both"), F.col("only_g"), F.col("only_b")
    return n.select(*cells, "both", "only_g", "only_b", share(both, both + og + ob).alias("jaccard"), share(both, both + og).alias("p_b_given_g"), share(both, both + ob).alias("p_g_given_b"), share(og, both + og).alias("g_specific"), share(ob, both + ob).alias("b_specific"))


# Moments ---------------------------------------------------------------------------------------------------------


def moments(d: Column, prefix: str = "") -> list[Column]:
    """Aggregates n, mean and sd of the non-null differences, named with the prefix and an underscore if there is one."""
    name = lambda k: f"{prefix}_{k}" if prefix else k
    return [F.count(d).cast("double").alias(name("n")), F.avg(d).alias(name("mean")), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias(name("sd"))]


def t_test(m: DataFrame, degenerate: str = "one", confidence: Sequence[float] = ()) -> DataFrame:
    """Adds t, p_two, p_greater, p_less (and intervals) to rows with n, mean, sd."""
    usable = (F.col("n") > 1) & (F.col("sd") > 0)
    m = m.withColumn("t", F.when(usable, F.col("mean") * F.sqrt("n") / F.when(usable, F.col("sd")).otherwise(1.0)).otherwise(0.0))
    up = t_sf(F.col("t"), F.greatest(F.col("n") - 1, F.lit(1.0)))
    flat = F.lit({"one": 1.0, "half": 0.5}[degenerate])
    m = m.withColumn("__up", up)
    m = m.withColumns({"p_two": F.when(usable, 2.0 * F.least("__up", 1.0 - F.col("__up"))).otherwise(1.0), "p_greater": F.when(usable, F.col("__up")).otherwise(flat), "p_less": F.when(usable, 1.0 - F.col("__up")).otherwise(flat)}).drop("__up")
    for i, level in enumerate(confidence):
        half = F.when(usable, t_quantile_column(0.5 + level / 2, F.greatest(F.col("n") - 1, F.lit(1.0))) * F.col("sd") / F.sqrt("n")).otherwise(0.0)
        m = m.withColumns({f"ci_low_{i}": F.col("mean") - half, f"ci_high_{i}": F.col("mean") + half})
    return m


def paired_t(df: DataFrame, cells: Sequence[str], d: Column, degenerate: str = "one", confidence: Sequence[float] = ()) -> DataFrame:
    """n, mean, sd, t, p_two, p_greater, p_less of paired differences; null differences are left out.

    Without variance or with one case: t = 0 and p_two = 1, and the one-sided values are 1 (degenerate="one") or 0.5
    ("half").  confidence adds ci_low_<i>, ci_high_<i> for each level (the mean where there is no variance).
    """
    # No filter on d before the sums: Spark would write the whole expression twice, and undo what its parts share.
    m = df.select(*cells, d.alias("__d")).groupBy(*cells).agg(*moments(F.col("__d")))
    return t_test(m.where("n > 0") if cells else m, degenerate, confidence)


def cohens_d(df: DataFrame, cells: Sequence[str], d: Column) -> DataFrame:
    m = df.groupBy(*cells).agg(F.avg(d).alias("mean"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("sd"))
    return m.select(*cells, F.when(F.col("sd") > 0, F.col("mean") / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)).otherwise(0.0).alias("d"))


def wilcoxon(df: DataFrame, cells: Sequence[str], d: Column, exact_below: int = 26) -> DataFrame:
    """Signed-rank test of non-zero differences: n, w (the smaller rank sum), z, p_two, and p_exact where it applies.

    Ranks are taken over the distinct absolute values of a cell, each with its counts, rather than over its rows, and
    from running totals of range partitions, so that a cell of any size is dealt over many tasks.  p_two is the normal
    approximation with correction for ties; p_exact is set for fewer than `exact_below` differences without ties.  df is
    read once.
    Without differences: w = 0, p = 1.
    """
    from evenkeel.operators.windows import few, running_total
    from evenkeel.scratch import Scratch

    ship(df.sparkSession)
    cases = df.select(*cells, d.alias("__d"))
    values = cases.groupBy(*cells, F.abs("__d").alias("a")).agg(F.count_if(F.col("__d") > 0).cast("double").alias("up"), F.count_if(F.col("__d") < 0).cast("double").alias("down"))
    kept = Scratch(df.sparkSession, "wilcoxon").keep(values, "values")
    values = kept.where("a != 0")
    tie = F.col("up") + F.col("down")
    every = running_total(values.withColumn("tie", tie), [*cells, "a"], "tie", "__before")
    firsts = few(every.groupBy(*cells).agg(F.min("__before").alias("__first")))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in cells]
    ranked = every.alias("x").join(firsts.alias("y"), same).select(*[F.col(f"x.{c}").alias(c) for c in cells], "up", "down", "tie", (F.col("__before") - F.col("__first") + (F.col("tie") + 1) / 2).alias("rank"))
    tie = F.col("tie")
    sums = ranked.groupBy(*cells).agg(F.sum(tie).alias("n"), F.sum(F.col("up") * F.col("rank")).alias("wp"), F.sum(F.col("down") * F.col("rank")).alias("wm"), F.sum(tie * tie * tie - tie).alias("ties"))
    every = kept.select(*cells).distinct().join(sums, list(cells), "left").fillna(0.0, ["n", "wp", "wm", "ties"])
    n, low = F.col("n"), F.least("wp", "wm")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = F.when(var > 0, (low - n * (n + 1) / 4) / F.sqrt(F.when(var > 0, var).otherwise(1.0))).otherwise(0.0)
    out = every.select(*cells, "n", low.alias("w"), z.alias("z"), "ties")
    p = F.when(F.col("n") > 0, F.least(F.lit(1.0), 2.0 * normal_sf(F.abs("z")))).otherwise(1.0)
    exact = F.when((F.col("ties") == 0) & (F.col("n") > 0) & (F.col("n") < exact_below), _exact_wilcoxon(F.col("w"), F.col("n")))
    return out.select(*cells, "n", "w", "z", p.alias("p_two"), exact.alias("p_exact"))


def exact_wilcoxon(w: float, n: int) -> float:
    """Two-sided p: the share of sign patterns with a rank sum of w or less, twice."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for r in range(1, n + 1):
        ways[r:] += ways[:-r].copy()
    return min(1.0, 2 * float(ways[: int(w) + 1].sum()) / 2.0**n)


@F.pandas_udf(T.DoubleType())
def _exact_wilcoxon(w: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([exact_wilcoxon(a, int(b)) if 0 < b < 60 else None for a, b in zip(w, n, strict=True)], dtype="float64")


# Regression ------------------------------------------------------------------------------------------------------


def ols_through_origin(df: DataFrame, cells: Sequence[str], x: Column, y: Column, centered: bool = False) -> DataFrame:
    """y = beta * x: n, beta, se, t, p_less (of beta < 0), r2 (uncentered; centered where x is a constant)."""
    m = df.groupBy(*cells).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"), F.sum(y).alias("sy"))
    beta = F.try_divide(F.col("sxy"), F.col("sxx"))
    rss = F.greatest(F.col("syy") - beta * F.col("sxy"), F.lit(0.0))
    se = F.sqrt(F.try_divide(rss, F.col("n") - 1) / F.col("sxx"))
    m = m.withColumns({"beta": beta, "rss": rss, "se": se}).withColumn("t", F.try_divide("beta", "se"))
    tss = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n") if centered else F.col("syy")
    return m.select(*cells, "n", "beta", "se", "t", (1.0 - t_sf(F.col("t"), F.col("n") - 1)).alias("p_less"), (1.0 - F.try_divide(F.col("rss"), tss)).alias("r2"))


def ols_clustered(df: DataFrame, cells: Sequence[str], z: str, s: str, y: str, cluster: str) -> DataFrame:
    """y = a + b z + c s with covariance robust to clusters: n, clusters, a, b, c, se_b, se_c, t_c, p_two, p_less, r2.

    Moments are centered as they are summed.  The scores of a cluster are summed in a second pass, to which the first
    sends one row per cell.  Collinear regressors, or a single cluster, give nulls.  p_two is normal, p_less Student's
    with n - 3 degrees of freedom.
    """
    from evenkeel.operators.windows import few

    m = df.groupBy(*cells).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(z).alias("mz"), F.avg(s).alias("ms"), F.avg(y).alias("my"),
        F.var_pop(z).alias("vz"), F.var_pop(s).alias("vs"), F.var_pop(y).alias("vy"), F.covar_pop(z, s).alias("zs"), F.covar_pop(z, y).alias("zy"), F.covar_pop(s, y).alias("sy"),
    )
    det = F.col("vz") * F.col("vs") - F.col("zs") * F.col("zs")
    sound = det > 1e-12 * F.col("vz") * F.col("vs")
    part = lambda a: F.when(sound, a / F.when(sound, det).otherwise(1.0))
    m = m.withColumns({"b": part(F.col("vs") * F.col("zy") - F.col("zs") * F.col("sy")), "c": part(F.col("vz") * F.col("sy") - F.col("zs") * F.col("zy")), "i11": part(F.col("vs")), "i12": part(-F.col("zs")), "i22": part(F.col("vz"))})
    dz, ds = F.col(z) - F.col("mz"), F.col(s) - F.col("ms")
    e = F.col(y) - F.col("my") - F.col("b") * dz - F.col("c") * ds
    fit = few(m.select(*cells, "mz", "ms", "my", "b", "c"))  # one row per cell
    joined = df.join(fit, list(cells)) if cells else df.crossJoin(fit)
    scores = joined.groupBy(*cells, cluster).agg(F.sum(dz * e).alias("u1"), F.sum(ds * e).alias("u2"), F.sum(e * e).alias("rss"))
    meat = scores.groupBy(*cells).agg(F.count(F.lit(1)).cast("double").alias("clusters"), F.sum(F.col("u1") * F.col("u1")).alias("m11"), F.sum(F.col("u1") * F.col("u2")).alias("m12"), F.sum(F.col("u2") * F.col("u2")).alias("m22"), F.sum("rss").alias("rss"))
    r = m.join(meat, list(cells)) if cells else m.crossJoin(meat)
    n, g = F.col("n"), F.col("clusters")
    scale = F.try_divide(g, g - 1) * F.try_divide(n - 1, n - 3) / (n * n)
    quad = lambda a, b: a * a * F.col("m11") + 2 * a * b * F.col("m12") + b * b * F.col("m22")
    r = r.withColumns({"a": F.col("my") - F.col("b") * F.col("mz") - F.col("c") * F.col("ms"), "se_b": F.sqrt(scale * quad(F.col("i11"), F.col("i12"))), "se_c": F.sqrt(scale * quad(F.col("i12"), F.col("i22")))})
    r = r.withColumn("t_c", F.try_divide("c", "se_c"))
    return r.select(*cells, "n", "clusters", "a", "b", "c", "se_b", "se_c", "t_c", (2.0 * normal_sf(F.abs("t_c"))).alias("p_two"), (1.0 - t_sf(F.col("t_c"), n - 3)).alias("p_less"), (1.0 - F.try_divide(F.col("rss"), n * F.col("vy"))).alias("r2"))


def held_out(df: DataFrame, cells: Sequence[str], truth: Column, fitted: Column) -> DataFrame:
    """rmse, and r2 against the test rows' own mean (0 where they do not vary)."""
    m = df.groupBy(*cells).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum((truth - fitted) * (truth - fitted)).alias("ssr"), (F.var_pop(truth) * F.count(truth)).alias("sst"))
    return m.select(*cells, "n", F.sqrt(F.col("ssr") / F.col("n")).alias("rmse"), F.when(F.col("sst") > 0, 1.0 - F.col("ssr") / F.when(F.col("sst") > 0, F.col("sst")).otherwise(1.0)).otherwise(0.0).alias("r2"))


def bonferroni(p: Column, tests: int, alpha: float = 0.05) -> Column:
    """Strictly under alpha / tests; null and NaN are not."""
    return F.coalesce(~F.isnan(p) & (p < alpha / tests), F.lit(False))


# Resampling ------------------------------------------------------------------------------------------------------

_EIGHT = [f"n{i}{j}{k}" for i in (0, 1) for j in (0, 1) for k in (0, 1)]


def _four(n: np.ndarray, arm: str) -> tuple[np.ndarray, ...]:
    t = n.reshape(*n.shape[:-1], 2, 2, 2)
    t = t.sum(axis=-1) if arm == "p" else t.sum(axis=-2)
    return t[..., 0, 0], t[..., 0, 1], t[..., 1, 0], t[..., 1, 1]


def np_metric(name: str, n00, n01, n10, n11) -> np.ndarray:
    n = n00 + n01 + n10 + n11
    with np.errstate(divide="ignore", invalid="ignore"):
        if name == "flip_rate":
            return (n01 + n10) / n
        if name == "phi":
            root = np.sqrt((n10 + n11) * (n00 + n01) * (n01 + n11) * (n00 + n10))
            return np.where(root > 0, (n11 * n00 - n10 * n01) / np.where(root > 0, root, 1), 0.0)
        total = 0.0
        for k, r, c in ((n00, n00 + n01, n00 + n10), (n01, n00 + n01, n01 + n11), (n10, n10 + n11, n00 + n10), (n11, n10 + n11, n01 + n11)):
            total = total + np.where(k > 0, k / n * np.log2(np.where(k > 0, k * n / np.where(r * c > 0, r * c, 1), 1.0)), 0.0)
        return total


def p_values(deltas: np.ndarray, observed: float, rule: str = "opposite") -> tuple[float, float, float]:
    """(two-sided, greater, less).  rule: "opposite" doubles the share on the other side of the observed sign; "both"
    doubles the smaller tail."""
    le, ge = float(np.mean(deltas <= 0)), float(np.mean(deltas >= 0))
    return min(1.0, 2 * min(le, ge) if rule == "both" else 2 * (le if observed >= 0 else ge)), le, ge


def _log_factorial(k: np.ndarray) -> np.ndarray:
    """ln k! of whole numbers, by Stirling's series from 64 on."""
    table = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 64)))))
    x = np.maximum(k, 63) + 1.0
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(k < 64, table[np.minimum(k, 63)], series)


def binomial_inverse(n: np.ndarray, q: float, u: np.ndarray) -> np.ndarray:
    """The least k whose cumulative binomial probability, of n trials of chance q, is u or more.

    Sums start nine standard deviations below the mean, where less than 1e-18 is left out.
    """
    if q <= 0 or q >= 1:
        return n * (q >= 1)
    spread = 9 * np.sqrt(n * q * (1 - q)) + 9
    low = np.maximum(0, np.floor(n * q - spread)).astype(np.int64)
    high = np.minimum(n, np.ceil(n * q + spread)).astype(np.int64)
    wide, out = int((high - low).max(initial=0)) + 1, np.empty(len(n), np.int64)
    step = max(1, (1 << 21) // wide)
    for i in range(0, len(n), step):
        m, k = n[i : i + step, None], low[i : i + step, None] + np.arange(wide)
        inside = k <= high[i : i + step, None]
        k = np.minimum(k, m)
        p = np.exp(_log_factorial(m) - _log_factorial(k) - _log_factorial(m - k) + k * math.log(q) + (m - k) * math.log(1 - q)) * inside
        out[i : i + step] = low[i : i + step] + ((np.cumsum(p, axis=1) < u[i : i + step, None]) & inside).sum(axis=1)
    return np.minimum(out, high)


def uniforms(key: str, replicates: int, columns: int) -> np.ndarray:
    """Numbers between 0 and 1: the first 52 bits of md5(key:replicate:column)."""
    import hashlib

    at = lambda b, j: int(hashlib.md5(f"{key}:{b}:{j}".encode()).hexdigest()[:13], 16)
    return (np.array([[at(b, j) for j in range(columns)] for b in range(replicates)], float).reshape(replicates, columns) + 0.5) / 2.0**52


def multinomial_inverse(counts: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A draw of sum(counts) for each row of u, kind after kind: each is binomial among what is left."""
    left, rest, out = np.full(len(u), int(counts.sum())), int(counts.sum()), []
    for j, c in enumerate(counts[:-1]):
        out.append(binomial_inverse(left, float(c) / rest if rest else 0.0, u[:, j]))
        left, rest = left - out[-1], rest - int(c)
    return np.stack([*out, left], axis=1).astype(float)


def bootstrap(counts: DataFrame, cells: Sequence[str], replicates: int = 1000, seed: int = 42, rule: str = "opposite", draws: str = "random") -> DataFrame:
    """Bootstrap of the difference of each count metric between the arms, from the eight counts of each cell.

    Resampling cases is drawing from a multinomial over the eight kinds of case, so that a cell's work does not grow
    with its cases.  All metrics of a cell share their replicates, whose seed is a hash of the cell's name.

    draws: "random" takes numpy's generator; "inverted" takes uniforms from md5 through the distribution functions, which
    any engine can repeat, and whose cost grows with the root of a cell's cases.
    """
    if draws not in ("random", "inverted"):
        raise ValueError(f"no draws {draws}")
    key = T.StructType([*(counts.schema[c] for c in cells)])
    schema = T.StructType([*key.fields, T.StructField("metric", T.StringType()), *(T.StructField(n, T.DoubleType()) for n in ("n", "observed", "p_two", "p_greater", "p_less", "ci_low", "ci_high", "se"))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                n = np.array([r[c] for c in _EIGHT])
                name = tuple(r[c] for c in cells)
                total = int(n.sum())
                if not total:
                    rows += [(*name, m, 0.0, *[None] * 7) for m in POPULATION]
                    continue
                if draws == "inverted":
                    drawn = multinomial_inverse(n, uniforms(":".join([str(seed), *("" if x is None else str(x) for x in name)]), replicates, 7))
                else:
                    rng = np.random.default_rng([seed, zlib.crc32(repr(name).encode())])
                    drawn = rng.multinomial(total, n / n.sum(), size=replicates).astype(float)
                for m in POPULATION:
                    diff = lambda x, m=m: np_metric(m, *_four(x, "p")) - np_metric(m, *_four(x, "b"))
                    d, seen = diff(drawn), float(diff(n))
                    two, greater, less = p_values(d, seen, rule)
                    low, high = np.percentile(d, [2.5, 97.5])
                    rows.append((*name, m, float(total), seen, two, greater, less, float(low), float(high), float(d.std())))
            yield pd.DataFrame(rows, columns=schema.names)

    ship(counts.sparkSession)
    return counts.select(*cells, *_EIGHT).mapInPandas(run, schema)


def bootstrap_rng(df: DataFrame, cells: Sequence[str], order: Sequence[str], o: str, p: str, b: str, metric: str = "flip_rate", replicates: int = 1000, seed: int = 42, most: int = 100_000) -> DataFrame:
    """The case-resampling bootstrap with numpy's default_rng(seed) over cases in the given order.

    For reproducing published values on small cells: a cell of more than `most` cases is an error, for which
    `bootstrap` is the way.
    """
    small = df.groupBy(*cells).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(*order, o, p, b))).alias("rows")).where(F.when(F.col("n") > most, F.raise_error(F.lit("too many cases for bootstrap_rng")).cast("boolean")).otherwise(True))
    schema = T.StructType([*(df.schema[c] for c in cells), *(T.StructField(n, T.DoubleType()) for n in ("observed", "p_two", "p_greater", "p_less"))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for r in x.to_dict("records"):
                v = np.array([[q[o], q[p], q[b]] for q in r["rows"]], dtype=int)
                rng = np.random.default_rng(seed)

                def diff(i: np.ndarray, v=v) -> float:
                    n = np.bincount(v[i] @ np.array([4, 2, 1]), minlength=8).astype(float)
                    return float(np_metric(metric, *_four(n, "p")) - np_metric(metric, *_four(n, "b")))

                seen = diff(np.arange(len(v)))
                d = np.array([diff(rng.choice(len(v), len(v), replace=True)) for _ in range(replicates)])
                rows.append((*(r[c] for c in cells), seen, *p_values(d, seen)))
            yield pd.DataFrame(rows, columns=schema.names)

    ship(df.sparkSession)
    return small.select(*cells, "rows").mapInPandas(run, schema)


def bootstrap_hash(df: DataFrame, x: str, y: str, replicates: int = 200, seed: int = 42) -> DataFrame:
    """Replicates (b, n00, n01, n10, n11) whose n picks are md5(b:k:seed) modulo n; the same in any SQL engine.

    Cases are taken in the order of their kind (00, 01, 10, 11), so that a pick tells its kind by the four counts alone
    and no case is looked up.  n * replicates hashes are taken, dealt over all tasks and counted before the shuffle;
    `bootstrap` draws the same distribution at a cost that does not depend on n.
    """
    kinds = [f"n{i}{j}" for i in (0, 1) for j in (0, 1)]
    held = pair_counts(df, [], x, y).first()
    sizes = [int(held[k]) for k in kinds]
    n, spark = sum(sizes), df.sparkSession
    key = F.concat_ws(":", F.floor(F.col("id") / max(1, n)).cast("string"), (F.col("id") % max(1, n)).cast("string"), F.lit(str(seed)))
    at = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % max(1, n)
    picks = spark.range(n * replicates).select(F.floor(F.col("id") / max(1, n)).alias("b"), at.alias("at"))
    ends = [sum(sizes[: i + 1]) for i in range(4)]
    return picks.groupBy("b").agg(*[F.count_if((F.col("at") >= end - size) & (F.col("at") < end)).cast("double").alias(k) for k, size, end in zip(kinds, sizes, ends, strict=True)])


def hypergeometric(good: int, bad: int, drawn: int) -> np.ndarray:
    """Probabilities of 0 to `drawn` good ones among `drawn` of good + bad."""
    lg = np.array([math.lgamma(i + 1) for i in range(good + bad + 1)])
    k = np.arange(drawn + 1)
    can = (k <= good) & (drawn - k <= bad)
    k = k[can]
    p = np.zeros(drawn + 1)
    p[can] = np.exp(lg[good] - lg[k] - lg[good - k] + lg[bad] - lg[drawn - k] - lg[bad - drawn + k] - lg[good + bad] + lg[drawn] + lg[good + bad - drawn])
    return p / p.sum()


def permutation(cases: DataFrame, cells: Sequence[str], k_a: str, n_a: str, k_b: str, n_b: str, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """Within-case label permutation of the mean Jensen-Shannon divergence of two sets of votes.

    cases: one row per case with ones and totals of both sets.  Shuffling a pool of votes leaves the first set's ones
    hypergeometric, so only counts are drawn.  Cases with equal counts are one kind, and how many of a kind's cases get
    each outcome is one multinomial draw, so that the work grows with the kinds and not with the cases.  Kinds are
    dealt over all tasks, each with a seed of its own, and their sums are added for each replicate, in the tasks first.
    p = (1 + replicates at or above the observed mean) / (1 + replicates).
    """
    kinds = cases.groupBy(*cells, k_a, n_a, k_b, n_b).agg(F.count("*").alias("times"))
    drawn = T.StructType([*(cases.schema[c] for c in cells), *(T.StructField(n, T.DoubleType()) for n in ("total", "active", "seen")), T.StructField("null", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        # A cell's kinds are added up in the task, so that a row for each cell and task is passed on, not one for each kind.
        held: dict[tuple, list] = {}

        def summed() -> pd.DataFrame:
            made = pd.DataFrame([(*k, *v[:3], v[3].tolist()) for k, v in held.items()], columns=drawn.names)
            held.clear()
            return made

        for pdf in batches:
            for r in pdf.to_dict("records"):
                a, na, b, nb, times = (int(r[c]) for c in (k_a, n_a, k_b, n_b, "times"))
                seen = times * float(_jsd_np(np.float64(a / na), np.float64(b / nb)))
                null = np.zeros(replicates)
                if active := 0 < a + b < na + nb:
                    rng = np.random.default_rng([seed, zlib.crc32(repr((tuple(r[c] for c in cells), a, na, b, nb)).encode())])
                    table = _jsd_np(np.arange(na + 1) / na, np.clip((a + b - np.arange(na + 1)) / nb, 0, 1))
                    null = rng.multinomial(times, hypergeometric(a + b, na + nb - a - b, na), size=replicates) @ table
                cell = held.setdefault(tuple(r[c] for c in cells), [0.0, 0.0, 0.0, np.zeros(replicates)])
                for i, x in enumerate((float(times), float(times * active), seen, null)):
                    cell[i] = cell[i] + x
                if len(held) >= 256:
                    yield summed()
        if held:
            yield summed()

    ship(cases.sparkSession)
    sums = kinds.repartition(*cells, k_a, n_a, k_b, n_b).mapInPandas(run, drawn)
    whole = sums.groupBy(*cells).agg(F.sum("total").alias("n"), F.sum("active").alias("active"), F.sum("seen").alias("seen"))
    null = sums.select(*cells, F.posexplode("null").alias("rep", "v")).groupBy(*cells, "rep").agg(F.sum("v").alias("v"))
    joined = null.join(whole, list(cells)) if cells else null.crossJoin(whole)
    stat = joined.groupBy(*cells, "n", "active", "seen").agg(F.avg(F.col("v") / F.col("n")).alias("null_mean"), F.stddev_pop(F.col("v") / F.col("n")).alias("null_sd"), F.count_if(F.col("v") / F.col("n") >= F.col("seen") / F.col("n") - 1e-12).alias("above"))
    return stat.select(*cells, "n", "active", (F.col("seen") / F.col("n")).alias("observed"), "null_mean", "null_sd", ((1 + F.col("above")) / (1.0 + replicates)).alias("p"))


# Simulation ------------------------------------------------------------------------------------------------------


def _jsd_np(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    out = 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        for a, b in ((p, q), (1 - p, 1 - q)):
            m = (a + b) / 2
            out = out + np.where(a > 0, a * np.log2(np.where(a > 0, a / m, 1)), 0) / 2 + np.where(b > 0, b * np.log2(np.where(b > 0, b / m, 1)), 0) / 2
    return out


def _kl_np(p: np.ndarray, q: np.ndarray, floor: float = 1e-10) -> np.ndarray:
    up = lambda x: np.maximum(x, floor) / (np.maximum(x, floor) + np.maximum(1 - x, floor))
    p, q = up(p), up(q)
    return p * np.log2(p / q) + (1 - p) * np.log2((1 - p) / (1 - q))


def _t_greater(d: np.ndarray) -> float:
    """One-sided p of a paired t-test; 1 without variance."""
    sd = d.std(ddof=1)
    return 1 - t_cdf(float(d.mean() * math.sqrt(len(d)) / sd), len(d) - 1) if sd > 0 else 1.0


def power(grid: DataFrame, n: int = 200, sims: int = 100, replicates: int = 200, seed: int = 42, sims_a_task: int = 25, spread: float = 2.0) -> DataFrame:
    """Detection rate and mean p of each of the five metrics, for each row (sigma_pert, sigma) of the grid.

    Logits are N(0, spread^2), the original answers their signs.  The targeted edit adds N(0, sigma_pert^2) to noise
    N(0, sigma^2), the benign one the noise alone; their answers are drawn from the logits' probabilities.
    Simulations are dealt out in stretches of sims_a_task, each with a seed of its own.
    """
    spark = grid.sparkSession
    stretches = spark.range(-(-sims // sims_a_task)).select(F.col("id").alias("stretch"))
    work = grid.select("sigma_pert", "sigma").crossJoin(F.broadcast(stretches)).repartition("sigma_pert", "sigma", "stretch")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                rng = np.random.default_rng([seed, int(r.sigma_pert * 1e6), int(r.sigma * 1e6), int(r.stretch)])
                for _ in range(min(sims_a_task, sims - int(r.stretch) * sims_a_task)):
                    z = rng.normal(0, spread, n)
                    o, p, q = (1 / (1 + np.exp(-x)) for x in (z, z + rng.normal(0, r.sigma_pert, n) + rng.normal(0, r.sigma, n), z + rng.normal(0, r.sigma, n)))
                    kinds = np.bincount((z > 0) * 4 + (rng.random(n) < p) * 2 + (rng.random(n) < q), minlength=8)
                    draws = rng.multinomial(n, kinds / n, size=replicates).astype(float)
                    for m, (_, side) in POPULATION.items():
                        d = np_metric(m, *_four(draws, "p")) - np_metric(m, *_four(draws, "b"))
                        rows.append((r.sigma_pert, r.sigma, m, float(np.mean(d <= 0 if side == "greater" else d >= 0))))
                    rows += [(r.sigma_pert, r.sigma, m, _t_greater(f(o, p) - f(o, q))) for m, f in (("jsd", _jsd_np), ("kl", _kl_np))]
            yield pd.DataFrame(rows, columns=["sigma_pert", "sigma", "metric", "p"])

    ship(spark)
    ps = work.mapInPandas(run, "sigma_pert double, sigma double, metric string, p double")
    return ps.groupBy("sigma_pert", "sigma", "metric").agg(F.avg((F.col("p") < 0.05).cast("double")).alias("detection_rate"), F.avg("p").alias("mean_p_value"), F.count("*").alias("sims"))
