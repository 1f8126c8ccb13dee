"""The shared folder's tables end with the application; named folders stay."""

import os
import subprocess
import sys

CODE = """
import sys
from pyspark.sql import SparkSession
from evenkeel.scratch import Scratch
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[1]).getOrCreate()
own, named = Scratch(spark, "own"), Scratch(spark, "named", folder="file://" + sys.argv[1] + "/named")
print("counts", own.keep(spark.range(5), "a").count(), named.keep_once(spark.range(3), "b").count(), named.keep_once(spark.range(9), "b").count(), own.root)
"""


def test_own_folders_end_with_the_application(tmp_path):
    out = subprocess.run([sys.executable, "-c", CODE, str(tmp_path)], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), timeout=240, check=True)
    counts, root = out.stdout.split("counts ")[1].split()[:3], out.stdout.split()[-1].removeprefix("file://")
    assert counts == ["5", "3", "3"] and root.startswith(str(tmp_path))
    assert not os.path.exists(root) and os.path.exists(tmp_path / "named" / "b" / "_SUCCESS")
