"""Samples: seeds from rows, batches within their budget, order, and odd values."""

import pytest
from pyspark.sql import functions as F

from evenkeel.functions import sampling


def maker():
    def model(prompts, seeds):
        return [(f"{p[:5]}:{s}", float(s % 7)) for p, s in zip(prompts, seeds, strict=True)]

    return lambda: model


def rows(spark, parts):
    return spark.range(150).select("id", F.when(F.col("id") % 11 != 3, F.concat_ws(" ", F.transform(F.sequence(F.lit(1), 1 + F.col("id") % 40), lambda i: F.concat(F.lit("w"), i)))).alias("p"), F.lit("k").alias("samples2")).repartition(parts)


def test_batches_and_partitions_make_no_difference(spark):
    made = []
    for parts, budget, most, buffer in ((1, 10_000, 500, 2048), (4, 64, 3, 10), (7, 1, 1, 1)):
        got = sampling.sample(rows(spark, parts), ["id"], "p", maker(), samples=4, budget=budget, most=most, buffer=buffer).collect()
        made.append({r["id"]: (r["p"], r["samples2"], r["samples"] and [tuple(s) for s in r["samples"]]) for r in got})
    assert made[0] == made[1] == made[2] and len(made[0]) == 150
    one = made[0][5][2]
    assert [s[0] for s in one] == [0, 1, 2, 3] and len({s[1] for s in one}) == 4 and all(s[2] == f"w1 w2:{s[1]}" for s in one)
    assert made[0][3][2] is None


def test_batches_keep_to_the_budget():
    lengths = [5, 900, 1, 40, 40, 3, 2000, 0, 7]
    made = list(sampling.batches(lengths, 100, 4))
    assert sorted(i for b in made for i in b) == list(range(9))
    assert all(len(b) == 1 or len(b) * max(lengths[i] for i in b) <= 100 for b in made) and all(len(b) <= 4 for b in made)
    assert made[0] == [6] and made[2] == [3, 4]
    assert list(sampling.batches([], 10, 3)) == []


def test_values_that_are_no_numbers(spark):
    odd = {0: float("nan"), 1: float("inf"), 2: float("-inf"), 3: None, 4: 250.0}
    df = spark.createDataFrame([(i, str(i)) for i in range(5)], "id int, p string")
    got = sampling.sample(df, ["id"], "p", lambda: lambda ps, ss: [(None, odd[int(p)]) for p in ps], samples=1).collect()
    assert {r["id"]: r["samples"][0]["logit"] for r in got} == {0: 0.0, 1: 100.0, 2: -100.0, 3: None, 4: 100.0}


def test_a_model_that_leaves_answers_out_is_an_error(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, p string").coalesce(1)
    with pytest.raises(Exception, match="shorter"):
        sampling.sample(df, ["id"], "p", lambda: lambda ps, ss: [("x", 0.0)]).collect()
    assert sampling.sample(df.limit(0), ["id"], "p", maker()).count() == 0
