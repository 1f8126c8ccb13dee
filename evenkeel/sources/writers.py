"""Sinks.  Spark's committer makes a folder's content appear at once; readers take a folder with _SUCCESS only."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Occupied(RuntimeError):
    """The place already holds results."""


def sheets(root: str, tables: Mapping[str, DataFrame], kind: str = "parquet") -> None:
    """Result tables of one analysis, a folder each.  They are small: one file."""
    for name, df in tables.items():
        out = df.coalesce(1).write.mode("overwrite")
        out.option("header", True).csv(f"{root}/{name}") if kind == "csv" else getattr(out, kind)(f"{root}/{name}")


def records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def csv_file(df: DataFrame, folder: str, name: str) -> None:
    """One CSV file of a given name in a folder, for small tables that are told apart by file name."""
    spark, held = df.sparkSession, f"{folder}-{uuid.uuid4().hex}"
    csv(df.coalesce(1), held)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(path(held)) if s.getPath().getName().startswith("part-"))
    fs.mkdirs(path(folder))
    if not fs.rename(part, path(folder, name)):
        raise FileExistsError(f"{folder}/{name}")
    fs.delete(path(held), True)


def json_object(df: DataFrame, key: str, path: str) -> None:
    """One JSON object in one file: the key's values as names, the other columns as records."""
    rest = [c for c in df.columns if c != key]
    name = F.to_json(F.array(F.col(key).cast("string")))
    name = F.substring(name, F.lit(2), F.length(name) - 2)
    joined(df.select(F.concat(name, F.lit(":"), F.to_json(F.struct(*rest)))), path, "{", ",", "}")


def json_array(df: DataFrame, path: str) -> None:
    """One JSON array of records in one file."""
    joined(df.select(F.to_json(F.struct(*df.columns))), path, "[", ",", "]")


def joined(lines: DataFrame, path: str, head: str, between: str, tail: str) -> None:
    """One file in the folder `path`: head, the lines of a text column with `between` before all but the first, tail.

    Tasks write their parts; these are copied one after the other, as streams, into the file.
    """
    spark, held = lines.sparkSession, f"{path}-{uuid.uuid4().hex}"
    # Every line brings its separator along; of the first, it is skipped.
    lines.select(F.concat(F.lit(between), F.col(lines.columns[0])).alias("value")).write.option("lineSep", "\n").text(held)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(held).getFileSystem(conf)
    parts = sorted(s.getPath().getName() for s in fs.listStatus(at(held)) if s.getPath().getName().startswith("part-") and s.getLen())
    fs.delete(at(path), True)
    out = fs.create(at(f"{held}/joined"))
    out.write(bytearray(head.encode()))
    for i, name in enumerate(parts):
        source = fs.open(at(f"{held}/{name}"))
        if i == 0:
            source.seek(len(between.encode()))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
        source.close()
    out.write(bytearray(tail.encode()))
    out.close()
    fs.mkdirs(at(path))
    fs.rename(at(f"{held}/joined"), at(f"{path}/part-00000.json"))
    fs.create(at(f"{path}/_SUCCESS")).close()
    fs.delete(at(held), True)


def version(df: DataFrame, root: str, number: int) -> str:
    """Writes a new version beside the older ones, and refuses to touch one that is there."""
    path = f"{root}/v={number}"
    df.write.mode("errorifexists").parquet(path)
    return path


def guarded(df: DataFrame, existing: DataFrame | None, path: str, prefix: str = "LLAMA") -> None:
    """Overwrites unless a column with the prefix holds a value in the existing table."""
    kept = [c for c in (existing.columns if existing is not None else []) if c.startswith(prefix)]
    if kept:
        held = existing.agg(*[F.coalesce(F.bool_or(F.col(c).isNotNull()), F.lit(False)).alias(c) for c in kept]).first()
        if any(held):
            raise Occupied(f"{path} holds values in {', '.join(c for c in kept if held[c])}")
    df.write.mode("overwrite").parquet(path)


def without(df: DataFrame, large: Iterable[str]) -> DataFrame:
    return df.drop(*large)


def metric_value(stats: DataFrame) -> DataFrame:
    """A table of one row as (metric, value)."""
    return stats.select(*[F.col(c).cast("double").alias(c) for c in stats.columns]).unpivot([], stats.columns, "metric", "value")
