"""What is asked of a case is computed once, however many sums it enters."""

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import windows
from evenkeel.plans import stats, studies


@pytest.fixture
def seen(spark):
    """Cases with a column x whose computation is counted, and the counter."""
    count = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def x(i):
        count.add(1)
        return float(i % 7) if i % 10 else None

    cases = spark.range(40).select((F.col("id") % 2).cast("string").alias("cell"), "id", x("id").alias("x"))
    return cases, count


def test_controlled_computes_a_case_once(seen):
    cases, count = seen
    got = studies.controlled(cases.withColumn("b", F.lit(2.0)), ["cell"], "x", "b", F.col("id") % 3 == 0, F.col("id") % 4 == 0, ["id"]).collect()
    assert sorted((r["cell"], r["n_cases"], r["median_b"]) for r in got) == [("0", 20, 2.0), ("1", 20, 2.0)]
    assert count.value == 40


def test_quantiles_read_their_input_once(seen):
    cases, count = seen
    got = windows.quantiles(cases, "x", (0.5,), ["cell"]).collect()
    assert sorted((r["cell"], r["q0"]) for r in got) == [("0", 3.0), ("1", 3.0)]
    assert count.value == 40


def test_wilcoxon_reads_its_input_once(seen):
    cases, count = seen
    got = stats.wilcoxon(cases, ["cell"], F.col("x") - 3.0).collect()
    assert sorted((r["cell"], r["n"]) for r in got) == [("0", 14.0), ("1", 17.0)]
    assert count.value == 40
