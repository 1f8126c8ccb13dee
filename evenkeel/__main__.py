"""Runs queries of the catalogue by name:  python -m evenkeel TABLES OUT NAME... [--kind parquet|csv|json].

TABLES is a folder of Parquet tables, OUT a folder that gets one folder for each query; without names, all that there are
run.  A query whose result is there already is passed over, so that a run that was cut off can be taken up again.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from evenkeel.plans import catalogue, catalogue_io, catalogue_search, catalogue_sources, catalogue_studies
from evenkeel.session import session

REGISTERED = (catalogue_io, catalogue_search, catalogue_sources, catalogue_studies)


def run_all(spark: SparkSession, tables: str, out: str, names: list[str], kind: str = "parquet") -> list[str]:
    """The names of the queries that were run."""
    made = catalogue.queries()
    unknown = sorted(set(names) - set(made))
    if unknown:
        raise ValueError(f"no query {', '.join(unknown)}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    done = []
    for name in names or sorted(made):
        if fs.exists(path(f"{out}/{name}/_SUCCESS")):
            continue
        writer = made[name](spark, tables).write.mode("overwrite")
        writer.option("header", True).csv(f"{out}/{name}") if kind == "csv" else getattr(writer, kind)(f"{out}/{name}")
        done.append(name)
    return done


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="evenkeel", description=__doc__)
    p.add_argument("tables")
    p.add_argument("out")
    p.add_argument("names", nargs="*")
    p.add_argument("--kind", choices=["parquet", "csv", "json"], default="parquet")
    a = p.parse_args(argv)
    for name in run_all(session(), a.tables, a.out, a.names, a.kind):
        print(name)


if __name__ == "__main__":
    main()
