import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.plans import battery, stats


def diffs(spark, **cells):
    return spark.createDataFrame([(k, v) for k, vs in cells.items() for v in vs], "cell string, d double")


def test_paired_t(spark):
    df = diffs(spark, a=[1.0, 2.0, 3.0, 4.0], flat=[2.0, 2.0], single=[1.0], gap=[1.0, None, 3.0])
    got = {r["cell"]: r for r in stats.paired_t(df, ["cell"], F.col("d"), confidence=(0.95,)).collect()}
    a = got["a"]
    assert math.isclose(a["t"], 2.5 / (np.std([1, 2, 3, 4], ddof=1) / 2)) and math.isclose(a["p_two"], 0.030466, rel_tol=1e-4)
    assert math.isclose(a["p_greater"] + a["p_less"], 1.0) and math.isclose(a["ci_low_0"], 2.5 - 3.182446305 * a["sd"] / 2, rel_tol=1e-6)
    for k in ("flat", "single"):
        assert (got[k]["t"], got[k]["p_two"], got[k]["p_greater"], got[k]["p_less"]) == (0.0, 1.0, 1.0, 1.0) and got[k]["ci_low_0"] == got[k]["mean"]
    assert got["gap"]["n"] == 2
    half = {r["cell"]: r for r in stats.paired_t(df, ["cell"], F.col("d"), "half").collect()}
    assert half["flat"]["p_greater"] == 0.5
    d = {r["cell"]: r["d"] for r in stats.cohens_d(df, ["cell"], F.col("d")).collect()}
    assert math.isclose(d["a"], 2.5 / np.std([1, 2, 3, 4], ddof=1)) and d["flat"] == d["single"] == 0.0


def test_wilcoxon(spark):
    df = diffs(spark, a=[1.0, -2.0, 3.0, 4.0, 5.0, -6.5, 7.0], ties=[1.0, 1.0, -1.0, 2.0, 0.0], zero=[0.0, 0.0])
    got = {r["cell"]: r for r in stats.wilcoxon(df, ["cell"], F.col("d")).collect()}
    ranks = range(1, 8)
    sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product([0, 1], repeat=7)]
    assert got["a"]["w"] == 2 + 6 and math.isclose(got["a"]["p_exact"], min(1.0, 2 * sum(s <= 8 for s in sums) / 128))
    assert (got["ties"]["n"], got["ties"]["w"], got["ties"]["p_exact"]) == (4.0, 2.0, None)
    assert (got["zero"]["n"], got["zero"]["w"], got["zero"]["p_two"]) == (0.0, 0.0, 1.0)


def test_counts(spark):
    rows = [("c", 1, 1)] * 4 + [("c", 1, 0)] * 2 + [("c", 0, 1)] + [("c", 0, 0)] * 3 + [("flat", 1, 1)] * 5
    df = spark.createDataFrame(rows, "cell string, x int, y int")
    c = stats.pair_counts(df, ["cell"], "x", "y")
    four = {k: F.col(k) for k in ("n00", "n01", "n10", "n11")}
    got = {r["cell"]: r for r in c.select("cell", stats.flip_rate(four).alias("f"), stats.mutual_information(four).alias("m"), stats.phi(four).alias("p")).collect()}
    assert math.isclose(got["c"]["f"], 0.3) and math.isclose(got["c"]["p"], 10 / math.sqrt(6 * 4 * 5 * 5))
    joint = np.array([[3, 1], [2, 4]]) / 10
    assert math.isclose(got["c"]["m"], sum(joint[i, j] * math.log2(joint[i, j] / joint[i].sum() / joint[:, j].sum()) for i in (0, 1) for j in (0, 1)))
    assert (got["flat"]["f"], got["flat"]["m"], got["flat"]["p"]) == (0.0, 0.0, 0.0)
    big = spark.range(1).select(*[F.lit(1e6).alias(k) for k in four])
    assert big.select(stats.phi(four).alias("p")).first()["p"] == 0.0
    stat, p = stats.mcnemar(F.lit(5.0), F.lit(5.0))
    assert spark.range(1).select(stat.alias("s")).first()["s"] == 0.1
    stat, p = stats.mcnemar(F.lit(0.0), F.lit(0.0))
    assert tuple(spark.range(1).select(stat, p).first()) == (0.0, 1.0)
    none = df.limit(0)
    assert stats.overlap(none, ["cell"], F.col("x") == 1, F.col("y") == 1).count() == 0


def test_regression(spark):
    rng = np.random.default_rng(1)
    n = 400
    z, s, g = rng.normal(100, 2, n), rng.choice([-1.0, 1.0], n), rng.integers(0, 40, n)
    y = 1.5 + 0.7 * z - 0.4 * s + rng.normal(0, 1, n) + rng.normal(0, 1, 40)[g]
    df = spark.createDataFrame([("c", float(a), float(b), float(c), int(k)) for a, b, c, k in zip(z, s, y, g, strict=True)] + [("line", 1.0, 1.0, float(i), i) for i in range(5)], "cell string, z double, s double, y double, g int")
    got = {r["cell"]: r for r in stats.ols_clustered(df, ["cell"], "z", "s", "y", "g").collect()}
    x = np.column_stack((np.ones(n), z, s))
    beta = np.linalg.solve(x.T @ x, x.T @ y)
    e = y - x @ beta
    meat = sum(np.outer(x[g == k].T @ e[g == k], x[g == k].T @ e[g == k]) for k in np.unique(g))
    k = len(np.unique(g))
    v = np.linalg.inv(x.T @ x) @ meat @ np.linalg.inv(x.T @ x) * k / (k - 1) * (n - 1) / (n - 3)
    c = got["c"]
    assert np.allclose([c["a"], c["b"], c["c"]], beta, rtol=1e-6) and np.allclose([c["se_b"], c["se_c"]], np.sqrt(np.diag(v))[1:], rtol=1e-6)
    assert got["line"]["b"] is None and got["line"]["se_c"] is None
    one = stats.ols_through_origin(df.where("cell = 'c'"), ["cell"], F.col("s"), F.col("y")).first()
    assert math.isclose(one["beta"], (s @ y) / (s @ s)) and math.isclose(one["se"], math.sqrt((y @ y - (s @ y) ** 2 / (s @ s)) / (n - 1) / (s @ s)), rel_tol=1e-9)


def test_bootstraps_agree(spark):
    rng = np.random.default_rng(5)
    o = rng.integers(0, 2, 300)
    p, b = np.where(rng.random(300) < 0.3, 1 - o, o), np.where(rng.random(300) < 0.15, 1 - o, o)
    df = spark.createDataFrame([("c", i, *map(int, v)) for i, v in enumerate(zip(o, p, b, strict=True))], "cell string, i int, o int, p int, b int")
    many = {r["metric"]: r for r in stats.bootstrap(stats.triple_counts(df, ["cell"], "o", "p", "b"), ["cell"], 2000).collect()}
    exact = stats.bootstrap_rng(df, ["cell"], ["i"], "o", "p", "b", replicates=1000).first()
    rng = np.random.default_rng(42)
    base = [float((o[i] != p[i]).mean() - (o[i] != b[i]).mean()) for i in (rng.choice(300, 300, replace=True) for _ in range(1000))]
    assert math.isclose(exact["p_greater"], np.mean(np.array(base) <= 0)) and math.isclose(exact["observed"], (o != p).mean() - (o != b).mean())
    assert math.isclose(many["flip_rate"]["observed"], exact["observed"]) and abs(many["flip_rate"]["se"] - np.std(base)) < 0.004
    assert many["phi"]["p_less"] < 0.05 and many["flip_rate"]["ci_low"] < exact["observed"] < many["flip_rate"]["ci_high"]
    again = {r["metric"]: r for r in stats.bootstrap(stats.triple_counts(df.repartition(7), ["cell"], "o", "p", "b"), ["cell"], 2000).collect()}
    assert again == many
    with pytest.raises(Exception, match="too many cases"):
        stats.bootstrap_rng(df, ["cell"], ["i"], "o", "p", "b", most=10).collect()


def test_rules_and_guards(spark):
    d = np.array([-1.0, 0.0, 1.0, 2.0])
    assert stats.p_values(d, 0.5) == (1.0, 0.5, 0.75) and stats.p_values(d, -0.5)[0] == 1.0 and stats.p_values(np.array([1.0, 2.0, -1.0, 3.0]), 2.0, "both")[0] == 0.5
    empty = spark.createDataFrame([("x", *[0.0] * 8)], "cell string, " + ", ".join(f"{n} double" for n in stats._EIGHT))
    rows = stats.bootstrap(empty, ["cell"]).withColumn("flag", stats.bonferroni(F.col("p_two"), 1)).collect()
    assert len(rows) == 3 and not any(r["flag"] for r in rows)


def test_permutation_controls(spark):
    rng = np.random.default_rng(2)
    same = [("same", int(rng.binomial(10, 0.5)), 10, int(rng.binomial(10, 0.5)), 10) for _ in range(60)]
    apart = [("apart", int(rng.binomial(10, 0.8)), 10, int(rng.binomial(10, 0.3)), 10) for _ in range(60)] + [("apart", 0, 10, 0, 10)]
    df = spark.createDataFrame(same + apart, "cell string, ka int, na int, kb int, nb int")
    got = {r["cell"]: r for r in stats.permutation(df, ["cell"], "ka", "na", "kb", "nb", 2000).collect()}
    assert got["apart"]["p"] < 0.01 < got["same"]["p"] and got["apart"]["active"] <= 60


def test_power_and_calibration(spark):
    grid = spark.createDataFrame([(0.0, 0.3), (3.0, 0.3)], "sigma_pert double, sigma double")
    got = {(r["sigma_pert"], r["metric"]): r for r in stats.power(grid, n=150, sims=30, replicates=100, spread=4.0).collect()}
    assert len(got) == 10 and got[3.0, "jsd"]["detection_rate"] > 0.8 and got[0.0, "kl"]["detection_rate"] < 0.25
    assert got[0.0, "flip_rate"]["sims"] == 30 and got[3.0, "flip_rate"]["detection_rate"] > 0.5 > 0.25 > got[0.0, "flip_rate"]["detection_rate"]


def test_battery_controls(spark):
    rng = np.random.default_rng(8)
    z = rng.normal(0, 2, 800)
    rows = [("hit", float(a), float(a + rng.normal(0, 3)), float(a + rng.normal(0, 0.2))) for a in z] + [("null", float(a), float(a + rng.normal(0, 0.5)), float(a + rng.normal(0, 0.5))) for a in z]
    df = spark.createDataFrame(rows, "cell string, logit_original double, logit_swapped double, logit_baseline double")
    got = battery.battery(df, ["cell"], 2, replicates=300)
    passes = {r["cell"]: r["passes"] for r in battery.control_passes(got, ["cell"]).collect()}
    assert passes["hit"] is False
    by = {(r["cell"], r["metric"]): r for r in got.collect()}
    assert len(by) == 10 and all(by["hit", m]["significant"] and by["hit", m]["p_one"] < 0.05 for m in ("flip_rate", "phi", "jsd", "kl"))
    assert {r["metric"]: (r["survived"], r["units"]) for r in battery.survival(got, ["metric"], ["cell"]).collect()}["jsd"][1] == 2


def test_inverted_draws_have_the_distribution():
    import math

    rng = np.random.default_rng(1)
    for n, q in ((0, 0.3), (1, 0.5), (7, 0.2), (40, 0.97), (3000, 0.41), (50, 0.0), (50, 1.0)):
        u = rng.random(400)
        cdf = np.cumsum([math.comb(n, k) * q**k * (1 - q) ** (n - k) for k in range(min(n, 60) + 1)]) if n < 1000 else None
        got = stats.binomial_inverse(np.full(400, n), q, u)
        if cdf is not None:
            assert got.tolist() == [int(min(n, (cdf < x).sum())) for x in u], (n, q)
        else:
            assert abs(got.mean() - n * q) < 6 * math.sqrt(n * q * (1 - q) / 400) and 0 <= got.min() and got.max() <= n
    counts = np.array([5, 0, 300, 2, 0, 40, 1, 7])
    drawn = stats.multinomial_inverse(counts, stats.uniforms("x", 500, 7))
    assert (drawn.sum(axis=1) == counts.sum()).all() and (drawn[:, [1, 4]] == 0).all()
    assert np.allclose(drawn.mean(axis=0), counts, atol=6 * np.sqrt(counts / 500 + 1e-9).max())
    assert np.allclose(stats._log_factorial(np.array([0, 1, 5, 63, 64, 200, 10_000])), [math.lgamma(k + 1) for k in (0, 1, 5, 63, 64, 200, 10_000)], rtol=1e-13)
