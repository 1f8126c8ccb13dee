import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import windows
from evenkeel.plans import stats


def shuffled(spark, n, parts):
    return spark.range(n, numPartitions=parts).select((F.col("id") * 7_368_787 % 1_000_000_007).alias("k"), F.col("id").alias("old"))


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_row_numbers_of_three_million_rows(spark, tmp_path, adaptive):
    path = str(tmp_path / "rows")
    shuffled(spark, 3_000_000, 16).write.parquet(path)
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        rows = spark.read.parquet(path)
        got = windows.row_index(rows, ["k"], "i").orderBy("i").select("i", "k").toPandas()
        assert (got["i"].to_numpy() == np.arange(3_000_000)).all() and (np.diff(got["k"].to_numpy()) > 0).all()
        shards = [windows.stride_shard(rows.select("k"), ["k"], 4, s) for s in range(4)]
        whole = shards[0].union(shards[1]).union(shards[2]).union(shards[3])
        assert [s.count() for s in shards] == [750_000] * 4 and whole.distinct().count() == 3_000_000
        runs = windows.contiguous_shard(rows.select("k"), ["k"], 7).groupBy("shard").agg(F.count("*").alias("n"), F.min("k").alias("a"), F.max("k").alias("b")).orderBy("shard").collect()
        assert [r["n"] for r in runs] == [428_571] * 6 + [428_574] and all(x["b"] < y["a"] for x, y in zip(runs, runs[1:], strict=False))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_numbers_within_groups_are_those_of_the_window(spark):
    rows = shuffled(spark, 20_000, 5).select(F.when(F.col("old") % 3 == 0, None).otherwise(F.col("old") % 7).alias("g"), "k")
    a, b = (sorted(map(tuple, f(rows, ["g"], ["k"]).collect()), key=str) for f in (windows.index_within, windows.index_within_large))
    assert a == b
    assert windows.row_index(rows.limit(0), ["k"]).count() == 0 and windows.index_within_large(rows.limit(0), ["g"], ["k"]).count() == 0


def test_running_totals_and_quantiles(spark):
    rng = random.Random(2)
    values = [float(rng.randrange(300)) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(6)
    total = sorted(map(tuple, windows.running_total(df.dropna().withColumn("w", F.lit(2)), ["v"], "w").collect()))
    assert [t[2] for t in total] == [2.0 * i for i in range(5000)]
    got = windows.quantiles(df, "v", (0, 0.25, 0.5, 0.95, 1)).first()
    assert list(got) == pytest.approx([float(np.quantile(values, q)) for q in (0, 0.25, 0.5, 0.95, 1)])
    assert list(windows.quantiles(df.limit(0), "v", (0.5,)).first()) == [None]


SHARES = (0, 0.25, 0.5, 0.95, 1)


def by_numpy(values):
    return [float(np.quantile(values, q)) for q in SHARES]


def test_quantiles_order_few_of_many_values(spark, monkeypatch):
    asked = []
    picked = windows._picked
    monkeypatch.setattr(windows, "_picked", lambda cells, *a: asked.append(cells.count()) or picked(cells, *a))
    df = spark.range(300_000, numPartitions=7).select(F.exp(F.col("id") * 7_368_787 % 1_000_003 / 1e5).alias("v"))
    got = windows.quantiles(df, "v", SHARES).first()
    assert list(got) == pytest.approx(by_numpy(df.toPandas()["v"]), rel=1e-12)
    assert len(asked) == 1 and asked[0] < 5_000


@pytest.mark.parametrize(("marks", "rows"), [("sketch", 0), ("wrong", 1_000_000), ("none", 0)])
def test_quantiles_do_not_depend_on_the_sketch(spark, monkeypatch, marks, rows):
    monkeypatch.setattr(windows, "WINDOW_ROWS", rows)
    if marks != "sketch":
        wrong = F.array(*[F.lit(x) for x in (5.0, 9.0, -1.0, -1.0, 60.0, 70.0, 8.0, 11.0, 2.0, 1.0)])
        monkeypatch.setattr(windows, "_marks", lambda rows, value, shares, group, also: rows.groupBy(*group).agg(*also, F.lit(None).cast("array<double>").alias("__marks") if marks == "none" else wrong.alias("__marks")))
    rng = random.Random(3)
    groups = {"a": [rng.gauss(0, 50) for _ in range(900)], "b": [7.5] * 40, "c": [1.0], None: [float(rng.randrange(12)) for _ in range(500)], "d": [-0.0, 0.0, float("-inf"), 3.0, 4.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]] + [("e", None)], "g string, v double").repartition(5)
    rows = windows.quantiles(df, "v", SHARES, ["g"], again=True, also=[F.count("v").alias("n")]).collect()
    assert {r["g"]: r["n"] for r in rows} == {"e": 0} | {g: len(vs) for g, vs in groups.items()}
    got = {r["g"]: [r[f"q{i}"] for i in range(1, 5)] for r in rows}
    assert got.pop("e") == [None] * 4
    assert got == {g: pytest.approx(by_numpy(vs)[1:]) for g, vs in groups.items()}
    alone = [v for vs in groups.values() for v in vs if v > -1e9]
    assert list(windows.quantiles(df.where("v > -1e9"), "v", SHARES).first()) == pytest.approx(by_numpy(alone))
    assert list(windows.quantiles(df.where("v IS NULL"), "v", (0.5,)).first()) == [None]


def test_quantiles_take_nan_as_the_largest(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", float("nan")), ("a", float("nan")), ("b", float("nan"))], "g string, v double")
    got = {r["g"]: (r["q0"], r["q1"]) for r in windows.quantiles(df, "v", (0.25, 1), ["g"]).collect()}
    assert got["a"][0] == 2.0 and np.isnan([got["a"][1], *got["b"]]).all()


def test_balanced_sample_of_hot_groups(spark):
    rows = spark.range(30_000).select(F.col("id"), F.when(F.col("id") < 29_000, "hot").when(F.col("id") < 29_960, "warm").otherwise("cold").alias("g"))
    got = windows.balanced_sample(rows, ["g"], ["id"]).collect()
    count = {g: sum(r["g"] == g for r in got) for g in ("hot", "warm", "cold")}
    assert count == {"hot": 40, "warm": 40, "cold": 40}
    best = rows.where("g = 'hot'").orderBy(windows.hashed(42, "id"), "id").limit(40).collect()
    assert {r["id"] for r in got if r["g"] == "hot"} == {r["id"] for r in best}
    alike = rows.select(F.lit(1).alias("id"), "g")  # no hash tells them apart
    assert windows.balanced_sample(alike, ["g"], ["id"]).groupBy("g").count().where("count = 40").count() == 3


def test_permutation_is_label_shuffling_for_common_kinds(spark):
    kinds = [(3, 10, 6, 10, 12_000), (1, 4, 1, 8, 500), (0, 5, 0, 5, 100)]
    rows = spark.createDataFrame([("c", *k[:4]) for k in kinds for _ in range(k[4])], "cell string, ka int, na int, kb int, nb int")
    got = stats.permutation(rows, ["cell"], "ka", "na", "kb", "nb", 2000).first()
    rng, total = np.random.default_rng(1), sum(k[4] for k in kinds)
    null = np.zeros(300)
    for a, na, b, nb, times in kinds:
        pool = np.array([1] * (a + b) + [0] * (na + nb - a - b))
        for i in range(300):
            ones = rng.permuted(np.tile(pool, (times, 1)), axis=1)[:, :na].sum(axis=1)
            null[i] += stats._jsd_np(ones / na, (a + b - ones) / nb).sum()
    null /= total
    assert got["n"] == total and got["active"] == 12_500
    assert got["null_mean"] == pytest.approx(null.mean(), abs=5 * null.std() / 300**0.5)
    assert 0.8 < got["null_sd"] / null.std() < 1.25  # a capped draw would be 1.1 times too wide per kind and more
    p = stats.hypergeometric(9, 11, 10)
    draws = rng.hypergeometric(9, 11, 10, 200_000)
    assert p == pytest.approx(np.bincount(draws, minlength=11) / 200_000, abs=0.01)


def test_lookup_raises_where_a_target_is_missing(spark):
    from evenkeel.operators import alignment

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    whole = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k long, w string")
    assert sorted(map(tuple, alignment.checked_lookup(rows, whole, ["k"], at_once=False).collect())) == [(1, "a", "x"), (2, "b", "y")]
    with pytest.raises(Exception, match="without a match"):
        alignment.checked_lookup(rows, whole.where("k != 2"), ["k"], at_once=False).collect()
