"""Results are kept only if their gates pass."""

import os

import pytest
from pyspark.sql import functions as F

from evenkeel.plans import studies


def test_kept_or_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    a, b = spark.range(100).select("id", (F.col("id") % 5).alias("k")).repartition(4), spark.createDataFrame([(1.0,), (None,)], "x double")
    gates = studies.keep_if(spark, root, {"a": (a, {"small": F.col("k") < 5, "whole": F.col("id") >= 0}), "b": (b, {})})
    assert sorted(map(tuple, gates.collect())) == [("small", 100, 100, True), ("whole", 100, 100, True)]
    assert spark.read.parquet(f"{root}/a").count() == 100 and spark.read.parquet(f"{root}/b").count() == 2
    assert sorted(x for x in os.listdir(tmp_path / "r") if not x.startswith(".")) == ["a", "b"]
    with pytest.raises(FileExistsError):
        studies.keep_if(spark, root, {"a": (a, {})})


@pytest.mark.parametrize("rows", ["b", "none"])
def test_a_failed_gate_leaves_nothing(spark, tmp_path, rows):
    root = f"file://{tmp_path}/r"
    a, b = spark.range(10), spark.createDataFrame([(1.0,), (None,)], "x double")
    b = b if rows == "b" else b.limit(0)
    with pytest.raises(studies.GatesFailed, match="gates failed: positive$") as e:
        studies.keep_if(spark, root, {"a": (a, {"all": F.col("id") < 10}), "b": (b, {"positive": F.col("x") > 0})})
    assert {r["gate"]: (r["n"], r["n_ok"], r["passed"]) for r in e.value.gates.collect()} == {"all": (10, 10, True), "positive": (2, 1, False) if rows == "b" else (0, 0, False)}
    assert not os.path.exists(tmp_path / "r" / "a") and not [x for x in os.listdir(tmp_path / "r")] if os.path.exists(tmp_path / "r") else True
    studies.keep_if(spark, root, {"a": (a, {})})


def test_an_error_while_writing_leaves_nothing(spark, tmp_path):
    bad = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("x"))
    with pytest.raises(Exception, match="broken"):
        studies.keep_if(spark, f"file://{tmp_path}/r", {"a": (spark.range(3), {}), "b": (bad, {})})
    assert not os.path.exists(tmp_path / "r" / "a")
