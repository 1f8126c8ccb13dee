"""Runs that are cut off: what is whole is kept, what is torn is done again."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from evenkeel.sources.pieces import Pieces, piece_of


def work(df):
    return df.select("id", (F.col("x") * 2).alias("y"))


def setting(spark, tmp_path, n=500, **more):
    df = spark.range(n).select("id", (F.col("id") % 7).alias("x"))
    return df, Pieces(spark, f"file://{tmp_path}/run", ["id"], **({"pieces": 12, "at_once": 4} | more))


def correct(spark, p, df):
    got = sorted(map(tuple, p.result(work(df).schema).collect()))
    return got == sorted(map(tuple, work(df).collect()))


def test_a_run_that_was_cut_off_is_continued(spark, tmp_path):
    df, p = setting(spark, tmp_path)
    assert p.run(df, work, waves=2) == list(range(8))
    with pytest.raises(ValueError, match="4 of 12"):
        p.result(work(df).schema)
    assert p.run(df, work) == [8, 9, 10, 11]
    assert p.run(df, work) == [] and correct(spark, p, df)


def test_torn_pieces_are_dropped_and_done_again(spark, tmp_path):
    df, p = setting(spark, tmp_path)
    p.run(df, work)
    files = lambda k: glob.glob(f"{tmp_path}/run/data/*/__piece={k}/*.parquet")
    os.remove(files(3)[0])
    with open(files(5)[0], "r+b") as f:
        f.truncate(40)
    assert p.run(df, work) == [3, 5] and correct(spark, p, df)


def test_files_without_a_line_are_no_part_of_the_result(spark, tmp_path):
    df, p = setting(spark, tmp_path)
    p.run(df, work, waves=1)
    work(df).withColumns({"__wave": F.lit("w-lost"), "__piece": piece_of(["id"], 12)}).write.mode("append").partitionBy("__wave", "__piece").parquet(f"{tmp_path}/run/data")
    assert p.run(df, work) == list(range(4, 12)) and correct(spark, p, df)


def test_changed_rows_are_found_by_reading(spark, tmp_path):
    df, p = setting(spark, tmp_path)
    p.run(df, work)
    path = glob.glob(f"{tmp_path}/run/data/*/__piece=2/*.parquet")[0]
    size = os.path.getsize(path)
    with open(path, "r+b") as f:
        f.seek(8)
        f.write(b"\xff" * 24)
    assert os.path.getsize(path) == size
    os.remove(os.path.join(os.path.dirname(path), "." + os.path.basename(path) + ".crc"))
    assert p.run(df, work) == [] and p.run(df, work, read=True) == [2] and correct(spark, p, df)


def test_empty_pieces_and_tables(spark, tmp_path):
    df, p = setting(spark, tmp_path, n=3)
    assert len(p.run(df, work)) == 12 and p.run(df, work) == [] and correct(spark, p, df)
    none, q = setting(spark, tmp_path / "none", n=0)
    q.run(none, work)
    assert q.result(work(none).schema).count() == 0
